"""Problem 1: one consistent form for text that looks the same but is stored in different characters.

Order of work on a text: invisible characters go, white space becomes a plain space or line feed, full-width and
half-width forms, ligatures and CJK radicals become ordinary characters, canonical composition joins accents, and the
words in alphabets with look-alike letters get one script. For the last step every letter has the set of scripts in
which a letter of its look exists; letters of any alphabet have at least their own. The sets are intersected over the
word: a word whose own letters come from several scripts is a mixed-script confusable, one in a single script that
could also be spelled in another is a whole-script confusable. Of the scripts left in the intersection, that with the
most unmistakable letters in the whole text is taken (in the order of SCRIPTS when equal), and the word is spelled in
it. When no script is left, letters that merely resemble those of another script (alpha and a) may stand for them, too,
since no word has letters of two scripts; alone, or in a word of their own script, they stay. If there is still no
script, each letter takes the first script of its look. All of this depends on looks alone, so texts that look the
same get the same form. Case, punctuation, number of spaces, superscripts, circled and styled letters stay.

Defined results: null stays null, an empty text stays empty, every row gives one row, repeated rows stay repeated,
other columns are ignored. Pairs: blank bodies take no part, a null title is an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.common import materialize, read_table, spread_join, spread_pairs

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
#: Letters of the same look, in the order of SCRIPTS; "-" where the script has none.
LOOKS = """
a а - - - | c с - - - | d ԁ - - - | e е - - - | h һ - հ - | i і - - - | j ј - յ - | l ӏ - - - | n - - ո - | o о ο օ - | p р - - - | q ԛ - զ -
s ѕ - - - | u - - ս - | v ѵ ν - - | w ԝ - - - | x х - - - | y у - - -
A А Α - Ꭺ | B В Β - Ᏼ | C С - - Ꮯ | D - - - Ꭰ | E Е Ε - Ꭼ | G - - - Ꮐ | H Н Η - Ꮋ | I І Ι - - | J Ј - - Ꭻ | K К Κ - Ꮶ | L - - - Ꮮ | M М Μ - Ꮇ
N - Ν - - | O О Ο Օ - | P Р Ρ - Ꮲ | Q Ԛ - - - | R - - - Ꭱ | S Ѕ - Տ Ꮪ | T Т Τ - Ꭲ | U - - Ս - | V - - - Ꮩ | W Ԝ - - Ꮃ | X Х Χ - - | Y Ү Υ - - | Z - Ζ - Ꮓ
- Г Γ - - | - П Π - - | - Ф Φ - -
"""
#: Letters that resemble those of another script; only a word that mixes scripts is read so.
NEAR = "a - α | i - ι | k к κ | n п η | p - ρ | u - υ | w - ω | x - χ | y - γ"
#: Latin letters drawn like others of the same script (script g, letters without their dot, small capitals).
DRAWN = dict(zip("ɡıȷᴄᴏᴜᴠᴡᴢꜱ", "gijcouvwzs", strict=True))
#: Letters of alphabets that have a dotless i of their own.
DOTLESS = re.compile("[ğĞşŞəƏİ]")
#: Characters without a look of their own (variation selectors and joiners are treated apart).
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200e\u200f\u2060\u2061\u2062\u2063\u2064"
    "\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0\ufff9\ufffa\ufffb"
)
LINE_ENDS = "\x0b\x0c\x85\u2028\u2029"
HYPHENS = "\u2010\u2011"


def _classes(table: str) -> dict[str, tuple[str, ...]]:
    out = {}
    for entry in table.replace("\n", "|").split("|"):
        letters = tuple(entry.split())
        out |= dict.fromkeys((x for x in letters if x != "-"), letters)
    return out


_CLASS, _NEAR = _classes(LOOKS), _classes(NEAR)
_TRANSLATE = dict.fromkeys(map(ord, INVISIBLE))
_TRANSLATE |= dict.fromkeys([c for c in range(32) if c not in (9, 10, 13)] + list(range(127, 160)))
_TRANSLATE |= {ord(c): "\n" for c in LINE_ENDS} | {ord(c): "-" for c in HYPHENS}
_TRANSLATE |= {c: " " for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs"}
_PLAIN = re.compile(r"[\t\n\x20-\x7e]*")
_WIDTH_FORMS = re.compile(r"[\u2e80-\u2fdf\ufb00-\ufb06\uff00-\uffef]+")
_JOINERS = re.compile(r"[\u200c\u200d\ufe00-\ufe0f]")
_SHAPED = re.compile(r"[\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff]")
#: Alphabets with letters that look like those of others: all between Latin and the scripts of the Near East, and Cherokee.
_OTHER_ALPHABET = re.compile(f"[{''.join(DRAWN)}\u0370-\u058f\u10a0-\u10ff\u13a0-\u13ff\u1f00-\u1fff\u2c80-\u2cff\uab70-\uabbf]")
_WORD = re.compile(r"[A-Za-z\u00aa\u00ba\u00c0-\u02af\u0300-\u058f\u10a0-\u10ff\u13a0-\u13ff\u1d00-\u1dbf\u1e00-\u1fff\u2c60-\u2cff\ua720-\ua7ff\uab30-\uabbf]+")


@lru_cache(maxsize=4096)
def _script(letter: str) -> str | None:
    """The script of a letter, the first word of its name; None for marks, which go with any."""
    return unicodedata.name(letter, "?").split()[0].capitalize() if letter.isalpha() else None


@lru_cache(maxsize=4096)
def _looks(letter: str, near: bool = False) -> frozenset[str] | None:
    """The scripts in which a letter of this look exists, or with ``near`` a letter that it resembles."""
    own = _script(letter)
    if own is None:
        return None
    scripts = {own} | {s for s, c in zip(SCRIPTS, _CLASS.get(letter, ()), strict=False) if c != "-"}
    return frozenset(scripts | ({s for s, c in zip(SCRIPTS, _NEAR.get(letter, ()), strict=False) if c != "-"} if near else set()))


def _spelled(letter: str, script: str) -> str:
    """The letter of this look in a script; itself if it has none."""
    at = SCRIPTS.index(script) if script in SCRIPTS else len(SCRIPTS)
    for table in (_CLASS, _NEAR):
        look = table.get(letter, ())
        if at < len(look) and look[at] != "-":
            return look[at]
    return letter


def _drop_joiners(text: str) -> str:
    """Joiners and variation selectors matter between emoji and in shaped scripts; elsewhere they go."""

    def keep(match: re.Match) -> str:
        at, end = match.start(), match.end()
        before, after = text[at - 1 : at], text[end : end + 1]
        if match.group() in "\u200c\u200d":
            emoji = all(c and unicodedata.category(c) in ("So", "Sk", "Mn", "Cn") for c in (before, after))
            return match.group() if emoji or _SHAPED.match(before) and _SHAPED.match(after) else ""
        return match.group() if before and unicodedata.category(before) in ("So", "Sm") else ""

    return _JOINERS.sub(keep, text)


def one_script(text: str) -> tuple[str, int, int]:
    """The text with every word in one script; numbers of mixed-script and of whole-script confusable words."""
    drawn = {} if DOTLESS.search(text) else DRAWN
    certain: Counter[str] = Counter()
    for word in _WORD.findall(text):
        for letter in unicodedata.normalize("NFD", word):
            looks = _looks(letter)
            if looks is not None and len(looks) == 1:
                certain.update(looks)
    counts = [0, 0]

    def candidates_of(word: str, near: bool) -> frozenset[str]:
        sets = [looks for looks in (_looks(x, near) for x in word) if looks is not None]
        return frozenset.intersection(*sets) if sets else frozenset()

    def respell(match: re.Match) -> str:
        word = unicodedata.normalize("NFD", match.group())
        if len(word) > 1 and drawn:
            word = "".join(drawn.get(x, x) for x in word)
        own = {script for script in map(_script, word) if script}
        candidates = candidates_of(word, False)
        counts[0] += len(own) > 1
        counts[1] += len(own) == 1 and len(candidates) > 1
        candidates = candidates or candidates_of(word, True)
        order = lambda s: (-certain[s], SCRIPTS.index(s) if s in SCRIPTS else len(SCRIPTS), s)
        if candidates:
            chosen = min(candidates, key=order)
            word = "".join(_spelled(x, chosen) for x in word)
        else:
            word = "".join(next((c for c in _CLASS.get(x, (x,)) if c != "-"), x) for x in word)
        return unicodedata.normalize("NFC", word)

    return _WORD.sub(respell, text), *counts


def unify_text(text: str | None) -> tuple[str | None, int, int]:
    """The consistent form of one text, with its numbers of mixed-script and whole-script confusable words."""
    if text is None or _PLAIN.fullmatch(text):
        return text, 0, 0
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(_TRANSLATE).replace("\u00b5", "\u03bc")
    if _JOINERS.search(text):
        text = _drop_joiners(text)
    text = _WIDTH_FORMS.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = unicodedata.normalize("NFC", text)
    if not _OTHER_ALPHABET.search(text):
        return text, 0, 0
    return one_script(text)


_RESULT = T.StructType([T.StructField("form", T.StringType()), T.StructField("mixed_words", T.IntegerType()), T.StructField("whole_script_words", T.IntegerType())])


@F.pandas_udf(_RESULT)
def unify(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unify_text(t) for t in texts], columns=["form", "mixed_words", "whole_script_words"])


def unify_columns(df: DataFrame, columns: tuple[str, ...] = ("title", "body"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the consistent form of each text column, and the numbers of confusable words in all."""
    made = df.select(*keep, *(unify(F.col(c)).alias(f"__{c}") for c in columns))
    total = lambda part: sum((F.col(f"__{c}.{part}") for c in columns), F.lit(0))
    return made.select(*keep, *(F.col(f"__{c}.form").alias(c) for c in columns), total("mixed_words").alias("mixed_words"), total("whole_script_words").alias("whole_script_words"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_columns(read_table(spark, sf_dir, "catalog_documents").select("doc_id", "title", "body"))


def classes(df: DataFrame) -> DataFrame:
    """doc_id, ``form`` (hash of the consistent title and body) and ``stored`` (hash of the stored ones) of every row with a body."""
    rows = df.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "body").filter(F.col("body").rlike(r"[^\s\p{Z}\p{C}]"))
    stored = F.unhex(F.sha2(F.concat_ws("\u0000", "title", "body"), 256))
    forms = unify_columns(rows.withColumn("stored", stored), keep=("doc_id", "stored"))
    return materialize(forms.select("doc_id", "stored", F.unhex(F.sha2(F.concat_ws("\u0000", "title", "body"), 256)).alias("form")))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with a body, the smallest id of the rows that look like it (class_id) and of those stored alike (stored_id).

    This is the operator's whole result, one row for each record however large a class is; pairs follow from it.
    """
    keyed = classes(read_table(spark, sf_dir, "catalog_documents"))
    of_form = keyed.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    of_stored = keyed.groupBy("form", "stored").agg(F.min("doc_id").alias("stored_id"), F.count(F.lit(1)).alias("copies"))
    made = spread_join(keyed, of_stored.drop("form"), "stored", "copies", "doc_id")
    return spread_join(made, of_form, "form", "members", "doc_id").select("doc_id", "class_id", "stored_id", "members", "copies")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows with the same form of title and body that are stored differently.

    Only forms stored in several ways reach the pairing, so copies without a difference make no pairs among
    themselves, and the pairs of a large form are spread over many tasks.
    """
    keyed = classes(read_table(spark, sf_dir, "catalog_documents"))
    several = keyed.groupBy("form").agg(F.min("stored").alias("least"), F.max("stored").alias("most")).filter("least <> most").select("form")
    members = materialize(keyed.join(several, "form", "left_semi"))
    pairs = spread_pairs(members, "form", "doc_id", "a.stored <> b.stored and a.doc_id < b.doc_id")
    return pairs.select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))
