"""Training of the tagger of pii_model from labelled spans: python -m strandlake.llm.pii_train TABLES_DIR [MINUTES [WEIGHTS]].

Spans are labelled by construction: mentions are composed by rules (forms of names, addresses, numbers and mail
addresses in several countries) and set into sentences: PATTERNS are of the kinds that the given tables hold, CARRIERS
were written for this purpose and aren't taken from any table. The background are sentences of at most MOST_TEXTS texts of
each given table, read and cut by Spark, that hold nothing which could be a mention: no sign of a mail address, few
digits, no rare pair of capitalised words, no Chinese surname before given names, and, once the tagger is able to tell,
nothing that it finds; training that goes on from weights leaves all of that to the tagger. The weights go to
pii_weights.npz beside this file.

``held_out`` measures on a fifth of CARRIERS, whole sentences that training never sees. The shipped weights come from
PATTERNS alone (CARRIER_SHARE 0), so that every sentence of CARRIERS is new to them; going on with a share of 0.3 did
better on new sentences and lost mentions of the tables (figures in the README).
"""

from __future__ import annotations

import multiprocessing as mp
import random
import re
import sys
import time
from collections import Counter

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.common import first_by_hash, read_table
from strandlake.llm.pii_model import CLASSES, FREE, HIDDEN, KINDS, TAGS, Tagger, char_classes, moves_of, spans_of

#: Texts of each table, of up to MOST_CHARS characters, that the background is taken from.
MOST_TEXTS, MOST_CHARS = 4000, 20_000
#: One of HOLD sentences that were written for this purpose is kept out of training, for ``held_out``.
HOLD = 5
#: Share of CARRIERS among the sentences with mentions.
CARRIER_SHARE = 0.0
FIRST = """Anna Ben Clara David Elena Felix Greta Hugo Ines Jonas Karin Liam Mara Nils Olga Paul Quentin Rosa Samuel Teresa Ulrich Vera Walter Xenia
Yasmin Zoe Aisha Bruno Chinedu Daria Emil Fatima Goran Hana Ivan Julia Kofi Leila Marco Nadia Omar Petra Ramona Sofia Tomas Ursula Viktor Wanda Yusuf
Amara Birgit Carlos Dolores Esther Farid Gloria Henrik Ingrid Javier Kwame Lucia Miguel Noor Otto Priya Rafael Sunniva Thaddeus Viggo Zoltan Pádraig
Calliope Osric Dagny Liselotte Gideon Marisol Jovana Emeka Hesper Tovi Oriane Maren""".split()
START, MIDDLE, FINISH = "Al An Bar Bel Bran Cor Dan Del Dun Eld Far Fen Gar Hal Har Ib Jas Ker Lind Lor Mar Mont Nor Ol Pel Quin Ros San Sol Tav Thorn Um Val Ver Wal Wex Zel Kow Sz Nak Ok Ash Grey Rook Night".split(), "a e i o u an en er in or al el mer ver den gre ba".split(), "berg son sen ton ley field man ski ova aldi etti ini ez ier eau ard vik ova idge well worth hurst wick croft dale strand anti ola aki iwa ic ulic erik oven ough ington comb cott inen ster dijk".split()
SURNAMES, GIVEN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段钱汤尹黎易常武乔贺赖龚文纪温闻祁柳", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红梅建国文斌辉宇浩然子轩雨涵思远清越知遥若云望舒景和予安沐言书瑶星墨川衡岚霖溪泽宁桐念晚野澈帆芷舟晴航砚初棠屿"
DOUBLE = ("欧阳", "司马", "上官", "诸葛")
STREETS = "Hawthorn Oak Maple Station Mill Church Park Garden Orchard Ferry Tanner Bell Marsh Lark Weir Market Chapel Harbour Meadow Elm Barn Lantern Cedar Willow Bridge King Queen Forest Spring River Hill Lake Abbey Windmill Quarry Cobbler Saddler Juniper Ferryman Tannery Bellfoundry Saltmarsh Larkspur Granary".split()
WAYS = "Street Road Lane Avenue Drive Close Court Way Rise Steps Terrace Crescent Place Row St Rd Ave Square Gardens Walk".split()
TOWNS = "Northport Westbridge Oakvale Millbrook Kingsford Upper_Barton Ashby Redhill Stonebury Eastham Marlow_Green Brackwater Tidewell Holmcastle Sundale Fernleigh Coldbrook Wetherfield Lanport Quillham Eastmarrow Narrowford Greywick Sandrigg Lower_Tamsin".split()
DE_STREETS, DE_TOWNS = ("Linden", "Berg", "Mühlen", "Garten", "Schul", "Kirch", "Birken", "Rosen", "Feld", "Wald", "Bach", "Markt", "Eichen", "Brunnen", "Hafen", "Post", "Sonnen", "Ziegel"), ("Neustadt", "Waldkirchen", "Grünau", "Seefeld", "Talheim", "Bergen", "Steinbach", "Altenhof", "Rosenau", "Königsfeld", "Burgdorf", "Brennsheim", "Nordlingstedt", "Altwörden")
ES_STREETS, ES_TOWNS = ("la Fuente", "las Flores", "Sol", "Olivar", "San Juan", "Mayor", "la Paz", "Real", "los Pinos", "Cervantes", "Molino", "Alfarero", "los Nogales"), ("Villanueva", "Campohermoso", "Santa Rosa", "Fuenteclara", "Montalto", "Ribera", "Alameda", "Robledal", "Torremirla", "Puerto Sereno")
FR_STREETS, FR_TOWNS = ("des Lilas", "de la Gare", "des Tilleuls", "Victor Hugo", "du Port", "de l'Église", "de la République", "du Moulin", "des Roses", "Pasteur", "du Vieux Moulin"), ("Montclair", "Beaulieu", "Rivecourt", "Saint-Aubin", "Fontenay", "Villeneuve", "Clairval", "Valbourg", "Saint-Orme")
CITIES, DISTRICTS, ROADS = ("江宁", "海州", "云山", "长平", "东川", "安和", "南浦", "西岭", "永泰", "龙泉", "平湖", "清河", "青岚", "临渊", "柏桥", "望溪"), ("新城", "南湖", "西山", "河东", "高新", "滨江", "鼓楼", "城北", "开发", "桥西", "云渡", "北榆", "松石", "东篱"), ("人民路", "中山街", "建设大道", "学院路", "花园巷", "解放路", "和平街", "文化路", "长江大道", "迎宾路", "胜利巷", "科技街", "芦花巷", "望山大道", "石榴路", "长桥街", "听雨路")
MAIL_WORDS = "mail inbox post lab7 students campus home work example marlow quiet finch copper ledger north river stone blue net".split()
ENDS = "com org net example test io de fr es co.uk edu".split()
R = random.Random()
#: Whether windows are made of the held-out sentences, or of the others.
HELD = [False]


def pick(options):
    return R.choice(options)


def digits(pattern: str) -> str:
    """``pattern`` with each 0 as a digit and each A as a capital letter."""
    return "".join(str(R.randrange(10)) if c == "0" else pick("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else c for c in pattern)


def surname() -> str:
    base = pick(START) + (pick(MIDDLE) if R.random() < 0.4 else "") + pick(FINISH)
    return ("O'" + base) if R.random() < 0.06 else pick(("van ", "de ", "Mc")) + base if R.random() < 0.04 else base


def forename() -> str:
    return pick(FIRST) if R.random() < 0.7 else pick(START) + pick(("a", "e", "ia", "o", "us", "an", "ine", "or", "y"))


def name() -> str:
    a, b = forename(), surname()
    middle = f" {pick('ABCDEFGHJKLMNPRSTW')}." if R.random() < 0.2 else ""
    form = R.random()
    if form < 0.6:
        made = f"{a}{middle} {b}"
    elif form < 0.75:
        made = f"{a[0]}. {b}"
    else:
        made = f"{b}, {a}{middle}"
    return made.upper() if R.random() < 0.08 else made.lower() if R.random() < 0.08 else made


def zh_name() -> str:
    family = pick(DOUBLE) if R.random() < 0.06 else pick(SURNAMES)
    return family + "".join(pick(GIVEN) for _ in range(1 if R.random() < 0.25 else 2))


def email() -> str:
    a, b = re.sub(r"[^a-z]", "", forename().lower()) or "kim", re.sub(r"[^a-z]", "", surname().lower()) or "lee"
    local = pick((f"{a}.{b}", f"{a}_{b}{R.randrange(100)}", f"{a}-{b}", f"{b}+jobs", f"{a[0]}{b}", f"{a}{R.randrange(1960, 2012)}", f"{a}{b}", b, f"{a}_{b}"))
    host = pick(MAIL_WORDS) + (pick(("-", ".", "")) + pick(MAIL_WORDS) if R.random() < 0.6 else "") + "." + pick(ENDS)
    form = R.random()
    if form < 0.6:
        made = f"{local}@{host}"
    elif form < 0.7:
        made = f"{local} @ {host}"
    elif form < 0.78:
        made = f"{local}＠{host}"
    elif form < 0.88:
        made = f"{local}{pick(('(at)', ' (at) ', '[at]', ' at '))}{host}"
    else:
        made = f"{local} [at] {host.replace('.', ' [dot] ')}"
    return made.upper() if R.random() < 0.1 else made


def phone(region: str) -> str:
    forms = {
        "en": ("000-555-0000", "(00) 0000 0000", "+61 000 000 000", "0000 000 000", "00000 000000", "+44 00 0000 0000", "555-0000", "000.555.0000", "000-555-0000 ext. 00", "0011 61 0 0000 0000", "+1 000 555 0000", "(000) 555-0000"),
        "de": ("000 00000 000", "0049/00/00000000", "+49 00 00000-000", "+49 000 0000000", "0000/000000"),
        "fr": ("+33 0 00 00 00 00", "00 00 00 00 00", "00.00.00.00.00", "0033 0 00 00 00 00"),
        "es": ("+34 000 00 00 00", "000 000 000", "900 000 000", "0034 000 000 000"),
        "zh": ("+86 000 0000 0000", "10000000000", "100-0000-0000", "100 0000 0000", "(000) 0000 0000", "000-00000000"),
    }
    forms |= {"ru": ("+7 900 000-00-00", "8 (000) 000-00-00"), "ja": ("03-0000-0000", "090-0000-0000", "+81 90 0000 0000")}
    made = digits(pick(forms[region]))
    if R.random() < 0.1:
        made = made.replace(" ", " ")
    if region == "zh" and R.random() < 0.08:
        made = made.translate({48 + k: 0xFF10 + k for k in range(10)})
    return made


def id_number(region: str) -> str:
    forms = {"en": ("000-00-0000", "AA 00 00 00 A", "AA000000A", "AA0000000", "A0000000", "000 000 000", "000000000"), "de": ("A00A00000", "AA00A0000", "00 000 000 000"), "fr": ("0 00 00 00 000 000", "0 00 00 00 000 000 00", "00AA00000"), "es": ("00000000A", "00000000-A", "A0000000A")}
    if region == "zh":
        made = digits("000000") + pick(("19", "20")) + digits("00") + f"{R.randrange(1, 13):02d}{R.randrange(1, 29):02d}" + digits("000") + pick("0123456789X")
        if R.random() < 0.25:
            made = f"{made[:6]} {made[6:14]} {made[14:]}"
        if R.random() < 0.06:
            made = made.translate({48 + k: 0xFF10 + k for k in range(10)})
        return made if R.random() < 0.9 else digits("A00000000")
    return digits(pick(forms.get(region, forms["en"])))


def address(region: str) -> str:
    number = str(R.randrange(1, 260))
    if region == "zh":
        made = f"{pick(CITIES)}市{pick(DISTRICTS)}区{pick(ROADS)}{number}号"
        return made + pick(("", f"{R.randrange(1, 9)}单元", f"{R.randrange(1, 9)}栋{R.randrange(100, 999)}室", f"{R.randrange(1, 30)}楼"))
    if region == "de":
        made = f"{pick(DE_STREETS)}{pick(('weg', 'straße', 'allee', 'rainweg', 'grundstraße', 'platz', 'str.'))} {number}, {digits('00000')} {pick(DE_TOWNS)}"
    elif region == "es":
        made = f"{pick(('calle', 'plaza', 'avenida', 'Calle', 'Avenida', 'paseo'))} {pick(('de ', 'del ', ''))}{pick(ES_STREETS)} {number}, {pick((f'{R.randrange(1, 9)}.º {pick("ABCD")}, ', ''))}{digits('00000')} {pick(ES_TOWNS)}"
    elif region == "fr":
        made = f"{number}{pick(('', '', ' bis', ' ter'))}{pick((' ', ', '))}{pick(('rue', 'avenue', 'place', 'boulevard', 'chemin'))} {pick(FR_STREETS)}, {digits('00000')} {pick(FR_TOWNS)}"
    else:
        unit = pick(("", "", f"Flat {R.randrange(1, 30)}{pick('ABC')}, ", f"Unit {R.randrange(1, 30)}/", f"Apt {R.randrange(1, 99)}, "))
        street = pick(STREETS) if R.random() < 0.7 else f"{pick(('Old', 'Ninth', 'Upper', 'Great'))} {pick(STREETS)}"
        made = f"{unit}{number} {street} {pick(WAYS)}, {pick(TOWNS).replace('_', ' ')}{pick(('', ' ' + digits('0000'), ', ' + digits('00000')))}"
    if R.random() < 0.12 and ", " in made:
        at = pick([m.start() for m in re.finditer(", ", made)])
        made = made[: at + 1] + "\n" + made[at + 2 :]
    return made


#: Sentences written for this purpose: {n} name, {e} mail address, {p} phone, {i} identity number, {a} address, {x} a project, {t} a thing, {k} a number, {m} a month.
CARRIERS = {
    "en": """{n} will chair the meeting on {x}.¦Minutes taken by {n} and sent to {e}.¦You can reach our office manager {n} at {p}.¦Dear {n},¦Kind regards, {n}¦Best wishes\n{n}\n{p}¦Supervisor: {n} ({e})¦Emergency contact: {n}, {p}¦Author: {n}
The parcel for {n} goes to {a}.¦She moved from {a} last spring.¦We met at {a} and walked home.¦Billing address: {a}¦Deliver to: {n}, {a}¦Residence: {a}.¦Applicant: {n}\nAddress: {a}\nMobile: {p}\nE-mail: {e}¦Lives at {a} since 2019.
Passport no. {i}¦National insurance number: {i}¦His tax file number is {i}.¦Social security {i}, issued in 2012.¦ID card {i} belongs to {n}.¦The licence was renewed under {i} for {n}.¦Please do not share the number {i} with anybody.¦Driver licence: {i}¦I gave them my tax number ({i}) by mistake.
Ring {p} if the gate is shut.¦Tel. {p}¦Fax: {p}¦Text {n} on {p} when you arrive.¦The hotline is {p}, weekdays only.¦Send comments to {e}, please.¦Mail {e} or ring {p}.¦An invitation went out to {e} yesterday.¦Forwarded by {e}¦{e} did not answer.¦Support is at {e}; urgent matters at {p}.
According to {n}, the {t} was never finished.¦{n} fixed the {t} and {n} wrote the tests.¦The talk by {n} about {x} was full.¦We thank {n} for the data.¦Mentor: {n}¦{x} was led by {n} until 2023.¦I worked with {n} on the {t} of {x}.¦Ask {n} who owns the {t}.¦Together with {n} I maintained {x}.¦My tutor, {n}, praised the {t}.¦{n} joined in 2021 and now owns the {t}.¦Signed: {n}, {m} 2022¦The {t} broke while {n} was on leave.¦In week {k}, {n} took over {x}.¦{n}'s review of {x} took {k} days.""",
    "de": """{n} leitet das Treffen zu {x}.¦Sehr geehrte Frau {n},¦Mit freundlichen Grüßen\n{n}¦Ansprechpartner: {n}, Tel. {p}¦Bitte an {e} senden.¦Telefon: {p}¦Mobil {p} (ab 9 Uhr)¦Lieferadresse: {n}, {a}¦Wohnhaft in {a}.¦Er zog nach {a}.¦Personalausweis: {i}¦Steuernummer {i}¦Reisepass Nr. {i} von {n}¦Das Protokoll schrieb {n}.¦{n} und {n} haben {x} getestet.¦Mein Betreuer {n} half bei {x}.¦Autorin: {n} ({e})¦Rückfragen an {n}, {e} oder {p}.¦Die Rechnung geht an {a}.¦{n} übernahm {x} im Jahr 2022.""",
    "fr": """{n} anime la réunion sur {x}.¦Madame {n},¦Cordialement,\n{n}¦Responsable : {n}, tél. {p}¦Envoyez vos remarques à {e}.¦Téléphone : {p}¦Adresse de livraison : {n}, {a}¦Domicilié au {a}.¦Il a déménagé au {a}.¦Carte d'identité : {i}¦Numéro de sécurité sociale {i}¦Passeport n° {i} de {n}¦Compte rendu de {n}.¦{n} et {n} ont testé {x}.¦Ma tutrice {n} a suivi {x}.¦Auteur : {n} ({e})¦Joindre {n} au {p} ou à {e}.¦La facture part au {a}.¦{n} a repris {x} en 2022.""",
    "es": """{n} dirige la reunión de {x}.¦Estimada {n}:¦Un saludo,\n{n}¦Responsable: {n}, tel. {p}¦Envíe sus comentarios a {e}.¦Teléfono: {p}¦Dirección de entrega: {n}, {a}¦Vive en {a}.¦Se mudó a {a}.¦DNI {i}¦Número de la seguridad social {i}¦Pasaporte {i} de {n}¦Acta redactada por {n}.¦{n} y {n} probaron {x}.¦Mi tutora {n} siguió {x}.¦Autor: {n} ({e})¦Localice a {n} en el {p} o en {e}.¦La factura va a {a}.¦{n} asumió {x} en 2022.¦Atenciosamente, {n}¦Moro em {a}.¦Fale com {n}: {p}.¦{n} testou {x} em 2021.""",
    "zh": """会议由{n}主持。¦尊敬的{n}：¦此致，{n}¦联络人：{n}（{p}）¦意见请发送至{e}。¦手机：{p}¦传真{p}¦收货地址：{a}¦现居{a}。¦上个月搬到{a}。¦身份证：{i}¦护照号码{i}¦证件号码为{i}，请妥善保管。¦会议纪要由{n}整理。¦{n}和{n}一起测试了{x}。¦导师{n}指导了{x}。¦作者：{n}（{e}）¦找{n}请打{p}或写信到{e}。¦账单寄到{a}。¦{n}在2022年接手{x}。
申请人{n}\n住所{a}\n电话{p}¦{x}的负责人换成了{n}。¦据{n}说，{t}还没有完成。¦谢谢{n}提供数据。¦我和{n}一起维护{t}。¦紧急联系人{n}，{p}¦{t}坏了，{n}当时在休假。¦抄送{e}¦第{k}周由{n}值班。¦{n}写了{t}的测试。""",
    "ru": """{n} ведёт встречу по {x}.¦С уважением,\n{n}¦Телефон: {p}¦Пишите на {e}.¦Паспорт {i}¦Спасибо, {n}, за помощь.¦Отчёт подготовил {n} ({e}).""",
    "ja": """{n}が{x}を担当します。¦電話 {p}¦連絡先は{e}です。¦{n}さんに確認してください。¦旅券番号 {i}¦議事録は{n}が作成しました。""",
}
#: Sentences to train on, of the kinds that the given tables hold, and look-alikes of these.
PATTERNS = {
    "en": """Questions about this page go to {n} at {e} or by phone on {p}.¦Contact: {n} <{e}>¦Reference: {n}, {p}, {e}.¦Tax and identity checks used {i}; mail the result to {e}.¦The draft still carries my home address, {a}, in the header.
The signed copy was sent to {a} for {n}.¦Please call {p} before noon; {k} slots are left.¦{e} reported {k} broken links in {x}.¦When {x} failed, {n} restarted the {t} by hand.¦Thanks to {n} and {n} for testing the {t}.¦Reviewed by {n} in week {k} of the course.
Her visa form for {x} lists the number {i}, so keep the file private.¦{n} | {a} | {p} | {e}¦My passport {i} expires soon.¦Write to {e} for details.¦I spoke with {n} about {x}.¦{n} wrote the {t}.¦Ship it to {a}.¦Call {n} on {p}.¦SSN: {i}¦Name: {n}\nPhone: {p}\nEmail: {e}¦{n}, {a}¦The {t} was handed over to {n} in 2024.¦Interviewer: {n}¦When {x} failed, {n} restarted the {t} by hand.¦Reviewed by {n} in week {k} of the {w} course.¦Thanks to {n} and {n} for testing the {t}.¦{n} and {n} met in the lab.¦As {n} said, the {t} works.¦Signed by {n}.""",
    "de": """Fragen zu {x} beantwortet {n} unter {p} oder {e}.¦Die Unterlagen gehen an {n}, {a}.¦Die Ausweisnummer {i} steht noch im Entwurf von {x}.¦Geprüft von {n} im Jahr 2025.¦Kontakt: {n}, {e}¦{n} | {a} | {p} | {e}¦{n} hat {x} neu gestartet.¦Meine Anschrift lautet {a}.¦Rückruf bitte an {p}.¦Dank an {n} für die Prüfung.""",
    "fr": """Pour toute question sur {x}, écrivez à {n}, {e}, ou appelez le {p}.¦Le dossier est envoyé à {n}, {a}.¦Le numéro {i} figure encore dans le brouillon de {x}.¦Relu par {n} en 2023.¦Contact : {n}, {e}¦{n} | {a} | {p} | {e}¦Merci à {n} pour les tests de {x}.¦J'habite au {a}.¦Appelez le {p} avant midi.""",
    "es": """Las dudas sobre {x} las atiende {n} en {e} o en el {p}.¦El expediente se envía a {n}, {a}.¦El documento {i} aparece todavía en el borrador de {x}.¦Revisado por {n} en 2024.¦Contacto: {n}, {e}¦{n} | {a} | {p} | {e}¦Gracias a {n} por probar {x}.¦Mi dirección es {a}.¦Llame al {p} antes del mediodía.¦Dúvidas sobre {x}: {n}, {e}.¦Revisto por {n} em 2024.""",
    "zh": """如有问题请联系{n}，邮箱{e}，电话{p}。¦推荐人：{n}，{p}，{e}。¦草稿页眉里仍有我的家庭住址：{a}。¦证件{i}已核对，结果发到{e}。¦表格里填写的身份证号是{i}，请不要公开该文件。¦签字版已寄往{a}，收件人{n}。¦请在中午之前拨打{p}，还剩{k}个名额。¦{x}出错后，由{n}手动重启{t}。¦{n}在2025年{m}月审阅了{x}。¦感谢{n}和{n}测试{t}。
{e}报告了{x}中的{k}个失效链接。¦{n} | {a} | {p} | {e}¦姓名：{n}\n电话：{p}\n邮箱：{e}¦负责人是{n}，住在{a}。¦护照号{i}即将到期。¦{n}同学负责{t}。""",
}
PATTERN_LOOKALIKES = """{j} 2020 – {j} 2024 | {x} | {w}¦{j} 2019 – {j} 2025 · {x} · {w}¦教育背景\n{j} 2021 – {j} 2023 | {x} | {w}¦## Education\n{j} 2018 – {j} 2021 | {x}
Run {d11} finished and wrote {k} rows for {x}.¦Shipment {d18} left the queue after {k} retries.¦Order 2024-5550-{d3} was closed together with build {d9}.¦Port 8080, room 4-120 and shelf 17 {s} stay reserved for {x}.¦Section 12 Main Results spans {k} pages, see figure 3-09.¦{x} and {x} are code names, not people.
The package @harbor/{w} pins model@v{k}.{k} for tests.¦@all the {t} is back.¦0.{d4} 17 32 64 128 256 512 1024 2048¦# {d10}¦Ticket {k}-{k} and invoice {d8} belong to {x}.¦The Main Street Gallery theme has {k} colours.¦订单号{d18}在重试{k}次后离开队列。¦任务{d11}已结束，共写入{k}行。¦第12号会议室留给{x}使用，座位{k}个。¦{x}和{x}都是项目代号，版本{k}.{k}。
Release {k}.{k}.{k} fixed {t} on 2024-05-{m}.¦SELECT * FROM t{d4} WHERE id = {d8}¦Die Bestellung {d10} ist erledigt.¦Le lot {d9} est prêt.¦El pedido {d10} está listo."""  # fmt: skip
#: Look-alikes written for this purpose: {j} month, {s} street, {w} word, {d8} so many digits.
LOOKALIKES = """{j} 2018 – {j} 2022 · {x} · {w}¦{j} 2016 to {j} 2019, {x}¦### {x} ({j} 2020)\n{w}¦{j} 2021 | {x} | {w} | remote
Job {d10} ended after {k} s with exit code 0.¦Parcel code {d18} is at depot {d4}.¦Serial {d12} and batch {d9} passed.¦Invoice 2023-{d4}-{d4} is paid.¦Build {d8} of {x} is green.¦Ports 9090, 5432 and {d4} are in use by {x}.¦The {s} Playbook is a theme, not a place.¦{x} and {x} are products.¦Room {k}-{k}, seat {k}.
Version {k}.{k}.{k} needs {w}@{k}.{k}.¦@team please look at the {t}.¦@{w} merged {x}.¦0.{d4} 1.{d4} 2.{d4} 3.{d4} 4.{d4}¦{d4} {d4} {d4} {d4} rows¦# {d8}¦commit {d7}a{d3}f of {x}¦The table has {d9} rows and {d3} columns.¦SELECT name, email FROM users WHERE id = {d7};¦On 2022-1{k}-0{k} the {t} of {x} was slow.
Die Sendung {d12} liegt im Lager.¦Le colis {d10} attend au dépôt.¦El lote {d11} salió del almacén.¦批次{d12}已经检验。¦包裹单号{d16}还在仓库，共{k}件。¦作业{d10}在{k}秒后结束。¦{x}和{x}是两个产品，版本{k}.{k}。¦发票{d10}已付，端口{d4}空闲。¦{k}号教室留给{x}。¦№ {d9} от {k}.{k}¦注文{d10}は発送済みです。¦{x} 的{t}用了{d7}行代码。"""  # fmt: skip
PROJECTS = ["Copper Ferry", "Amber Loom", "Quiet Finch", "Silver Compass", "Mossy Willow", "Hidden Sparrow", "Gilded Walnut", "Paper Almanac", "Crimson Gate", "Blue Lantern", "Iron Kettle", "Velvet Harbor", "Lucky Pebble", "Wooden Bridge", "Rapid Otter", "Golden Thread"]
ZH_PROJECTS = ("白石引擎", "夜航助手", "北辰档案馆", "松间地图", "静水看板", "拾光沙盒", "远山索引", "青竹平台", "明月书库", "飞鸟网关")
THINGS = {"en": ("query planner", "upload form", "chunking step", "dashboard", "parser", "feature store", "login screen", "search index"), "zh": ("查询规划", "上传表单", "清洗步骤", "检索层", "登录页", "解析器")}


def fill(sentence: str, region: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A carrier filled with made-up mentions, and their spans."""
    makers = {"n": (zh_name if region in ("zh", "ja") and R.random() < 0.95 else name, "name"), "e": (email, "email"), "p": (lambda: phone(region), "phone"), "i": (lambda: id_number(region), "id_number"), "a": (lambda: address(region), "address")}
    plain = {"x": lambda: pick(ZH_PROJECTS) if region == "zh" and R.random() < 0.8 else pick(PROJECTS), "t": lambda: pick(THINGS.get(region, THINGS["en"])), "k": lambda: str(R.randrange(1, 9999)), "m": lambda: str(R.randrange(1, 13)), "j": lambda: pick("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()), "s": lambda: f"{pick(STREETS)} {pick(WAYS)}", "w": lambda: pick(MAIL_WORDS)}
    text, spans = "", []
    for part in re.split(r"(\{\w+\})", sentence):
        key = part[1:-1] if part.startswith("{") else None
        if key in makers:
            made = makers[key][0]()
            spans.append((len(text), len(text) + len(made), makers[key][1]))
            text += made
        elif key in plain:
            text += plain[key]()
        elif key and key[0] == "d":
            text += digits("0" * int(key[1:]))
        else:
            text += part
    return text, spans


def window(background: dict[str, list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of one training window of ``size`` characters."""
    region = pick(("en", "en", "en", "en", "zh", "zh", "zh", "de", "fr", "es", "es", "ru", "ja"))
    text, spans = "", []
    while len(text) < size + 60:
        roll = R.random()
        source = 2 if HELD[0] else R.random() < CARRIER_SHARE
        if roll < 0.4:
            part, found = fill(pick(LINES), region) if R.random() < 0.2 else fill(pick(_sentences_of(region, source)), region)
        elif roll < 0.52:
            part, found = fill(pick(_sentences_of("", source)), region)
        else:
            part, found = pick(background.get(region) or background["en"]) if R.random() < 0.85 else pick(background[pick(sorted(background))]), []
        if R.random() < 0.04:
            part = part.upper()
        text_before = text + pick(("", "", "- ", "Note: ", "备注：" if region == "zh" else "TODO – ")) if R.random() < 0.3 else text
        spans += [(len(text_before) + a, len(text_before) + b, k) for a, b, k in found]
        text = text_before + part + ("" if region == "zh" and R.random() < 0.6 else pick((" ", " ", "\n", "\n\n")))
    begin = R.randrange(0, 60) if R.random() < 0.5 else 0
    tags = np.zeros(len(text), np.int8)
    for a, b, kind in spans:
        tags[a] = 1 + KINDS.index(kind)
        tags[a + 1 : b] = FREE + KINDS.index(kind)
    tags = tags[begin : begin + size].copy()
    if tags[0] >= FREE:  # a mention cut by the window's begin begins there
        tags[0] -= len(KINDS)
    return char_classes(text)[begin : begin + size], tags


#: Lines of several mentions, as in signatures and headers.
LINES = ("{n} | {a} | {p} | {e}", "{n} | {p} | {e}", "{n}, {a}", "{n} <{e}>", "{e} | {p}", "{n}\n{a}\n{p}", "{p} · {e}", "{n}\n{e}\n{p}", "{n} ({p})")
_sentences: dict[tuple[str, int], list[str]] = {}


def _sentences_of(region: str, source: int) -> list[str]:
    """The sentences of a region, or the look-alikes for none: 0 of PATTERNS, 1 of CARRIERS to train on, 2 of those held out."""
    key = (region, int(source))
    if key not in _sentences:
        known = {"": LOOKALIKES} | CARRIERS if source else {"": PATTERN_LOOKALIKES} | PATTERNS
        every = [s for block in known.get(region, known["en"]).split("\n") for s in block.split("¦")]
        _sentences[key] = every if not source else [s for k, s in enumerate(every) if (k % HOLD == 0) == (source == 2)]
    return _sentences[key]


#: What a background sentence may not hold: signs of mail addresses, and five digits or more together.
_SIGNS = re.compile(r"[@＠]|[(\[ ](?:at|AT)[)\] ]|(?:[\d０-９][ ()/.\-]{0,2}){5}")
_PAIR = re.compile(r"[A-ZÀ-Þ][\w'’.-]*,? (?:[A-Z]\. )?[A-ZÀ-Þ][\w'’-]+")
_ZH_NAME = re.compile(f"(?:[{SURNAMES}]|{'|'.join(DOUBLE)})[{GIVEN}]{{1,2}}")


def sentences_by_language(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Sentences of a bounded number of texts of both tables, by the language of their script or label."""
    texts = []
    for table, key, text, label in (("documents", "doc_id", "text", "lang"), ("catalog_documents", "doc_id", "body", "language")):
        rows = read_table(spark, folder, table)
        chosen = first_by_hash(rows.filter(F.length(text).between(1, MOST_CHARS)).select(key), key, MOST_TEXTS)
        texts.append(rows.join(chosen, key, "left_semi").select(F.col(text).alias("text"), F.lower(F.substring(label, 1, 2)).alias("label")))
    cut = texts[0].unionByName(texts[1]).select("label", F.explode(F.split("text", r"(?<=[!?。！？])\s*|\n+|(?<=[a-z\d)%]\.)\s+")).alias("s")).filter("length(s) between 9 and 259").distinct()
    language = F.when(F.col("s").rlike("[぀-ヿ]"), "ja").when(F.col("s").rlike("[一-鿿]"), "zh").when(F.col("s").rlike("[а-я]"), "ru").when(F.col("label").isin("de", "fr", "es", "en"), F.col("label")).when(F.col("label") == "ge", "de").when(F.col("label") == "sp", "es").otherwise("en")
    out: dict[str, list[str]] = {}
    for row in cut.select(language.alias("language"), "s").orderBy("s").toLocalIterator():  # sentences of 2 * MOST_TEXTS texts
        out.setdefault(row.language, []).append(row.s)
    return out


def background_of(sentences: dict[str, list[str]], tagger: Tagger | None = None) -> dict[str, list[str]]:
    """Sentences that hold nothing which could be a mention; pairs of capitalised words that are common are no names.

    With a ``tagger``, those without a sign of a mail address in which it finds nothing.
    """
    pairs = Counter(m for rows in sentences.values() for s in rows for m in set(_PAIR.findall(s)))
    common = {p for p, n in pairs.items() if n >= 4}
    PROJECTS.extend(sorted(p for p in common if re.fullmatch("[A-Z][a-z]+ [A-Z][a-z]+", p)))
    if tagger:
        return without_mentions(tagger, {k: [s for s in rows if not re.search("[@＠]", s)] for k, rows in sentences.items()})
    plain = lambda s: not _SIGNS.search(s) and all(p in common for p in _PAIR.findall(s)) and not _ZH_NAME.search(s)
    return {language: kept for language, rows in sentences.items() if (kept := [s for s in rows if plain(s)])}


def start(seed: int = 1) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"{d}_x"] = g.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
        p[f"{d}_x"][:, HIDDEN : 2 * HIDDEN] += 1.5
        p[f"{d}_u"] = np.concatenate([np.linalg.qr(g.normal(size=(HIDDEN, HIDDEN)))[0] for _ in range(4)], axis=1)
        p[f"{d}_out"] = g.normal(0, 0.3, (HIDDEN, len(TAGS)))
    p |= {"bias": np.zeros(len(TAGS)), "leave": np.zeros(len(TAGS)), "enter": np.zeros(FREE), "stay": np.zeros((2, len(KINDS)))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def gradients(p: dict[str, np.ndarray], classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log likelihood per character of [time, batch] and its gradients."""
    steps, batch = classes.shape
    n, grads, kept = HIDDEN, {k: np.zeros_like(v) for k, v in p.items()}, {}
    for d in "fb":
        h = c = np.zeros((batch, n), np.float32)
        trace = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = h @ p[f"{d}_u"] + p[f"{d}_x"][classes[t]]
            g = np.clip(0.25 * z[:, : 3 * n] + 0.5, 0, 1)
            new, before, last = np.clip(z[:, 3 * n :], -1, 1), c, h
            c = g[:, n : 2 * n] * c + g[:, :n] * new
            out = np.clip(c, -1, 1)
            h = g[:, 2 * n :] * out
            trace.append((t, g, new, before, last, out, h))
        kept[d] = trace
    states = {}
    for d in "fb":
        states[d] = np.empty((steps, batch, n), np.float32)
        for row in kept[d]:
            states[d][row[0]] = row[6]
    e = states["f"] @ p["f_out"] + states["b"] @ p["b_out"] + p["bias"]
    moves, rows, size = moves_of(p), np.arange(batch), len(TAGS)

    def fold(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=-1, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True)))[..., 0]

    alpha, beta = np.empty((steps, batch, size)), np.zeros((steps, batch, size))
    alpha[0] = e[0]
    alpha[0, :, FREE:] -= 1e4
    for t in range(1, steps):
        alpha[t] = fold(alpha[t - 1][:, None, :] + moves.T) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = fold((beta[t + 1] + e[t + 1])[:, None, :] + moves)
    total = fold(alpha[-1])
    marginal = np.exp(alpha + beta - total[None, :, None])
    gold = np.zeros_like(marginal)
    gold[np.arange(steps)[:, None], rows, tags] = 1
    score = (e * gold).sum() + moves[tags[:-1], tags[1:]].sum()
    grad_moves = np.zeros_like(moves, dtype=np.float64)
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, :, None] + moves + (e[t] + beta[t])[:, None, :] - total[:, None, None])
        grad_moves += pair.sum(axis=0)
    np.add.at(grad_moves, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    grads["leave"], grads["enter"] = grad_moves[:, :FREE].sum(axis=1), grad_moves[:, :FREE].sum(axis=0)
    kinds = np.arange(len(KINDS))
    grads["stay"] = np.stack([grad_moves[1 + kinds, FREE + kinds], grad_moves[FREE + kinds, FREE + kinds]])
    de = (marginal - gold).astype(np.float32)
    grads["bias"] = de.sum(axis=(0, 1))
    for d in "fb":
        grads[f"{d}_out"] = np.einsum("tbh,tbk->hk", states[d], de)
        dh_all = de @ p[f"{d}_out"].T
        dh_next, dc_next = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        dz_all = np.empty((steps, batch, 4 * n), np.float32)
        for t, g, new, before, last, out, _ in reversed(kept[d]):
            dh = dh_all[t] + dh_next
            do = dh * out
            dc = dh * g[:, 2 * n :] * (np.abs(out) < 1) + dc_next
            dg = np.concatenate([dc * new, dc * before, do], axis=1) * (0.25 * ((g > 0) & (g < 1)))
            dz = np.concatenate([dg, dc * g[:, :n] * (np.abs(new) < 1)], axis=1)
            dz_all[t] = dz
            grads[f"{d}_u"] += last.T @ dz
            dh_next, dc_next = dz @ p[f"{d}_u"].T, dc * g[:, n : 2 * n]
        order = np.argsort(classes, axis=None, kind="stable")
        present, begins = np.unique(classes.ravel()[order], return_index=True)
        grads[f"{d}_x"][present] = np.add.reduceat(dz_all.reshape(-1, 4 * n)[order], begins, axis=0)
    count = steps * batch
    return float(total.sum() - score) / count, {k: (v / count).astype(np.float32) for k, v in grads.items()}


_background: dict[str, list[str]] = {}


def _shard(job: tuple[dict[str, np.ndarray], int, int, int]) -> tuple[float, dict[str, np.ndarray]]:
    p, seed, batch, size = job
    R.seed(seed)
    made = [window(_background, size) for _ in range(batch)]
    return gradients(p, np.stack([m[0] for m in made], axis=1), np.stack([m[1] for m in made], axis=1))


def train(spark: SparkSession, folder: str, minutes: float, begin: str | None = None, workers: int = 8, batch: int = 24, size: int = 200) -> None:
    """Adam on fresh windows for some minutes, from the weights in ``begin`` or from the start."""
    global _background
    _background = background_of(sentences_by_language(spark, folder), Tagger.load(begin) if begin else None)
    p = {k: x.astype(np.float32) for k, x in np.load(begin).items()} if begin else start()
    most = 0.006 if begin else 0.02
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in "mv")
    began, step, loss = time.time(), 0, 0.0
    for until in (1.0,) if begin else (0.35, 1.0):
        with mp.get_context("fork").Pool(workers) as pool:
            while (spent := (time.time() - began) / 60 / minutes) < until:
                step += 1
                rate = most * (1 - spent) * min(1, step / 30) + 1e-4
                parts = pool.map(_shard, [(p, step * 1000 + k, batch, size) for k in range(workers)])
                loss = 0.95 * loss + 0.05 * np.mean([x[0] for x in parts]) if step > 1 else parts[0][0]
                grads = {k: sum(x[1][k] for x in parts) / workers for k in p}
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1, 1 / (norm + 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.005 * (g**2 - v[k])
                    p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
                if step % 50 == 0:
                    print(step, round(loss, 5), round(spent, 2), flush=True)
        if until < 1:  # sentences in which the tagger by now finds a mention aren't background
            _background = without_mentions(Tagger(p), _background)
    np.savez_compressed(__file__.replace("pii_train.py", "pii_weights.npz"), **{k: x.astype(np.float16) for k, x in p.items()})


def without_mentions(tagger: Tagger, background: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sentences in which the tagger finds nothing."""
    out = {}
    for language, rows in background.items():
        rows, kept = sorted(rows, key=len), []
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            classes = np.zeros((len(part[-1]), len(part)), np.intp)
            for column, text in enumerate(part):
                classes[: len(text), column] = char_classes(text)
            tagged = tagger.decode(classes, np.array([len(t) for t in part])).any(axis=0)
            kept += [t for t, found in zip(part, tagged, strict=True) if not found]
        out[language] = kept or rows
    return out


def held_out(windows: int = 400, seed: int = 7) -> dict[str, tuple[float, float]]:
    """(precision, recall) of exact spans by kind on windows made of the held-out sentences."""
    R.seed(seed)
    HELD[0] = True
    tagger, hits = Tagger.load(), {k: [0, 0, 0] for k in KINDS}
    made = [window(_background, 200) for _ in range(windows)]
    HELD[0] = False
    paths = tagger.decode(np.stack([x[0] for x in made], axis=1), np.full(windows, 200))
    for k, (_, tags) in enumerate(made):
        gold, found = spans_of(tags), spans_of(paths[:, k])
        for kind in KINDS:
            a, b = {s for s in gold if s[2] == kind}, {s for s in found if s[2] == kind}
            hits[kind] = [hits[kind][0] + len(a & b), hits[kind][1] + len(b), hits[kind][2] + len(a)]
    return {k: (round(h / max(1, f), 3), round(h / max(1, g), 3)) for k, (h, f, g) in hits.items()}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    train(session, sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 5, sys.argv[3] if len(sys.argv) > 3 else None)
    print(held_out())
