"""Text functions over columns: cleaning, tokens, language, dates, titles, urls.

All keep nulls (null in, null out) unless said otherwise, and run inside generated code but for entity unescaping,
which only sees texts with an ampersand.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that count as white space, spelled out because Java and Python differ.
SPACES = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The token forms of the chunk budget and of search.
BUDGET_TOKEN = rf"[A-Za-z0-9][A-Za-z0-9.+#:_/-]*|[\x{{3400}}-\x{{9FFF}}]|[^{SPACES}A-Za-z0-9\x{{3400}}-\x{{9FFF}}]"
LATIN_TERM = r"[a-z0-9][a-z0-9.+#:_/-]*"
HAN_RUN = r"[\x{3400}-\x{9FFF}]+"
#: Domain ends that make a bare host an address of the web, and the grammar of mail and web addresses.
WEB_ENDS = (
    "com", "org", "net", "edu", "gov", "io", "dev", "app", "ai", "co", "me", "info", "biz", "au", "cn", "uk", "technology", "tech", "cloud", "online", "site", "store", "xyz",
    "digital", "solutions", "agency", "studio", "design", "work", "jobs", "space",
)
LABEL = r"[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?"
EMAIL = rf"(?iu)(?<![A-Z0-9_.+\-'])[A-Z0-9_%+\-']+(?:\.[A-Z0-9_%+\-']+)*@{LABEL}(?:\.{LABEL})*\.[A-Z]{{2,63}}(?![A-Z0-9_-]|\.[A-Z0-9])"
PATH = r"(?:/[A-Z0-9._~%!$&'()*+,;=:@/-]*)?(?:\?[A-Z0-9._~%!$&'()*+,;=:@/?-]*)?(?:#[A-Z0-9._~%!$&'()*+,;=:@/?-]*)?"
URL = rf"(?iu)(?<![@A-Z0-9_])(?:https?://(?:localhost|\[[0-9A-F:.]+\]|[A-Z0-9](?:[A-Z0-9.-]*[A-Z0-9])?)(?::\d{{1,5}})?|(?:{LABEL}\.)+(?:{'|'.join(WEB_ENDS)}))(?![A-Z0-9_-]){PATH}"
CLOSING = r"[.,;:!?)\]}'\"’”]*"


def strip_unicode(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def normalize_whitespace(text: Column) -> Column:
    """One kind of line break, single blanks, no blanks around breaks, at most one empty line; no-break spaces stay."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\t\f\x0B ]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return strip_unicode(F.regexp_replace(text, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_entities(text: Column) -> Column:
    """Character entities as characters, one level."""
    return F.when(F.contains(text, F.lit("&")), _unescape(text)).otherwise(text)


def remove_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "")


def remove_urls(text: Column) -> Column:
    """Web addresses go; closing punctuation after them stays. The address itself ends before trailing punctuation."""
    bare = URL.replace("(?iu)", "")
    return F.regexp_replace(text, rf"(?iu)(?:{bare}(?<![.,;:!?)\]}}'\"’”]))|(?:{bare}?(?={CLOSING}(?:[{SPACES}]|$)))", "")


def clean_text(text: Column, *, whitespace: bool = True, urls: bool = False, emails: bool = False) -> Column:
    """Markup and entities out, then mail and web addresses if wanted, then white space."""
    text = unescape_entities(F.translate(text, "\u0000", " "))
    text = F.regexp_replace(text, r"(?i)<script[\s\S]*?</script>", " ")
    text = F.regexp_replace(text, r"(?i)<style[\s\S]*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    if emails:
        text = remove_emails(text)
    if urls:
        text = remove_urls(text)
    return normalize_whitespace(text) if whitespace else text


def clean_flat(text: Column) -> Column:
    """As a folder scan cleans: no markup, all white space single."""
    text = F.regexp_replace(unescape_entities(text), r"<[^>]+>", " ")
    return strip_unicode(F.regexp_replace(text, rf"[{SPACES}]+", " "))


#: A mail address and the punctuation after a web address on the published side.
PUBLIC_EMAIL = r"[\p{L}\p{N}.!#$%&'*+/=?^_`{|}~-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
PUBLIC_CLOSING = ".,;:!?，。；：！？)）"


def clean_public(text: Column, *, whitespace: bool = True, urls: bool = False, emails: bool = False) -> Column:
    """As published texts are cleaned: no handling of markup; web addresses by scheme only, punctuation after them stays."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    if urls:
        text = F.regexp_replace(text, rf"(?i)https?://(?=[^{SPACES}<>])[^{SPACES}<>]*?([{PUBLIC_CLOSING}]*)(?=[{SPACES}<>]|$)", "$1")
    if emails:
        text = F.regexp_replace(text, PUBLIC_EMAIL, "")
    return normalize_whitespace(text) if whitespace else strip_unicode(text)


def count_tokens(text: Column) -> Column:
    """Tokens of the chunk budget; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(BUDGET_TOKEN)).cast("bigint")


def search_tokens(text: Column) -> Column:
    """Latin terms, then the single characters of each Han run followed by its pairs; an empty array for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    singles = lambda run: F.filter(F.split(run, ""), lambda c: c != "")
    pairs = lambda run: F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda k: F.substring(run, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    han = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(HAN_RUN), F.lit(0)), lambda run: F.concat(singles(run), pairs(run))))
    return F.concat(F.regexp_extract_all(low, F.lit(LATIN_TERM), F.lit(0)), han)


def count_search_tokens(text: Column) -> Column:
    """The number of ``search_tokens``, by counting alone: a Han run of n characters has n of them and n - 1 pairs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda pattern: F.regexp_count(low, F.lit(pattern))
    return count(LATIN_TERM) + 2 * count(r"[\x{3400}-\x{9FFF}]") - count(HAN_RUN)


def detect_language(text: Column) -> Column:
    """zh if at least three characters and a twentieth of the text are Han, else en."""
    han = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    return F.when(text.isNull(), None).when(han >= F.greatest(F.lit(3.0), F.length(text) * 0.05), "zh").otherwise("en")


def contains_han(text: Column) -> Column:
    return text.rlike(r"[\x{4E00}-\x{9FFF}]")


def markdown_title(text: Column, fallback: Column) -> Column:
    """The first level-one heading, else the fallback."""
    found = F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1))
    return F.coalesce(F.when(F.length(found) > 0, found), fallback)


def is_mojibake(text: Column) -> Column:
    """Text whose bytes were read in the wrong encoding: replacement characters or typical pairs."""
    return F.coalesce(text.rlike(r"\x{FFFD}|Ã[\x{80}-\x{BF}]|â€|锟斤拷"), F.lit(False))


def valid_http_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(F.trim(url), F.lit("HOST")).isNotNull(), F.lit(False))


def date_number(*fields: Column) -> Column:
    """YYYYMMDD as a number from the first field with a year 20xx; months and days default to 1 and 0-padding is free."""
    pattern = r"(20\d{2})(?:[-/.](\d{1,2}))?(?:[-/.](\d{1,2}))?"
    part = lambda f, k: F.regexp_extract(f, pattern, k)
    number = lambda f: part(f, 1).try_cast("int") * 10000 + F.coalesce(part(f, 2).try_cast("int"), F.lit(1)) * 100 + F.coalesce(part(f, 3).try_cast("int"), F.lit(1))
    return F.coalesce(*(F.when(f.rlike(pattern), number(f)) for f in fields)).cast("double")


def slugify(name: Column) -> Column:
    """Lower-case words joined by hyphens; "space" if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(slug) > 0, slug).otherwise(F.lit("space"))


def file_stem(path: Column) -> Column:
    """The last part of a path without its ending."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def version_title_key(title: Column) -> Column:
    """A title without what tells versions apart: numbers (after "v" or "version", too), words such as copy or final, punctuation."""
    low = F.regexp_replace(F.lower(title), r"(?U)\b(?:v(?:ersion)?\s*)?\d+(?:\.\d+)*\b", " ")
    # Words that tell versions apart
    low = F.regexp_replace(low, r"(?U)\b(?:copy|final|latest|master|old|new|updated|中文|英文|cn|en)\b", " ")
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{M}\p{N}_]+", " "))


def has_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether any of a few fixed markers occurs in the lower-cased text."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(rf"\Q{marker}\E" for marker in markers))  # lowered once, and not for each marker


#: Private data that the local check names, and kinds that block publication, in their order of precedence.
LOCAL_PII = {"email": r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "phone": r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)"}
PUBLIC_PII = {
    "email": r"(?:[^\W_]|[.!#$%&'*+/=?^_`{|}~-])+@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+",
    "national_id": r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])",
    "phone": r"(?<![0-9])(?:1[3-9][0-9]{9}|0?4[0-9]{8}|(?:\+?[0-9]{1,3}[ -]?)?(?:\(?[0-9]{2,4}\)?[ -])[0-9]{3,4}[ -][0-9]{3,4})(?![0-9])",
    "address": r"(?:家庭住址|家庭地址|住址|home address|residential address)\s*[：:]\s*[^\n]+",
}
#: A telephone number of so many digits is none.
MOST_PHONE_DIGITS = 16


def local_pii(text: Column) -> Column:
    """All mail addresses and Chinese mobile numbers with their values: (kind, value), mail first."""
    text = F.coalesce(text, F.lit(""))
    of = lambda kind: F.transform(F.regexp_extract_all(text, F.lit(LOCAL_PII[kind]), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(of("email"), of("phone"))


def local_pii_kinds(text: Column) -> Column:
    """Kinds of private data that the local check names: email, phone (Chinese mobile numbers)."""
    return F.array_distinct(F.transform(local_pii(text), lambda f: f["kind"]))


_PUBLIC = {kind: re.compile(pattern, re.I) for kind, pattern in PUBLIC_PII.items()}


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the blocking findings of one text; a kind gives way to those before it."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _PUBLIC.items():
        added = []
        for match in pattern.finditer(text or ""):
            begin, end = match.span()
            if kind == "phone" and sum(c in "0123456789" for c in match.group()) > MOST_PHONE_DIGITS:
                continue
            at = bisect_left(found, (end,))  # findings don't overlap, so only the last one that begins before the end can
            if not at or found[at - 1][1] <= begin:
                added.append((begin, end, kind))
        found = sorted(found + added)
    return found


def public_pii_spans(text: Column) -> Column:
    """Where the data that blocks publication stands (start_pos, end_pos, kind), in code points and in order."""

    @F.pandas_udf("array<struct<start_pos int, end_pos int, kind string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(spans_of)

    return spans(text)


def public_pii_kinds(text: Column) -> Column:
    """Kinds that block publication: email, national_id, phone, address."""
    kinds = F.transform(public_pii_spans(F.coalesce(text, F.lit(""))), lambda s: s["kind"])
    return F.array_intersect(F.array(*map(F.lit, PUBLIC_PII)), kinds)


#: Elements that begin a line of text, and the named entities that are decoded (others stay).
BLOCKS = "article|div|ol|p|section|table|tbody|thead|ul"
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
_UNREAD = re.compile(r"<(script|style|head|nav)\b.*?</\1\s*>", re.I | re.S)
_ROW, _CELL = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.I | re.S), re.compile(r"<(?:td|th)\b[^>]*>(.*?)</(?:td|th)>", re.I | re.S)
_HEADING, _ITEM = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1>", re.I | re.S), re.compile(r"<li\b[^>]*>(.*?)</li>", re.I | re.S)
_BREAK, _TAG = re.compile(rf"<br\s*/?>|</?(?:{BLOCKS})\b[^>]*>", re.I), re.compile(r"<[^>]+>")
_ENTITY = re.compile(r"&(?:#x([0-9a-f]{1,6})|#(\d{1,7})|([a-z]+));", re.I)


def _decoded(text: str) -> str:
    def of(match: re.Match) -> str:
        code = int(match[1], 16) if match[1] else int(match[2]) if match[2] else None
        if code is None:
            return ENTITIES.get(match[3].lower(), match[0])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else match[0]

    return _ENTITY.sub(of, text)


def structured_text(markup: str) -> str:
    """The text of one page: headings as #, list items as -, cells of a row joined by |, blocks on lines of their own."""
    inner = lambda part: " ".join(_decoded(_TAG.sub("", part)).split())
    text = _UNREAD.sub(" ", markup) if "<" in markup else markup
    if "<" in text:
        text = _ROW.sub(lambda m: "\n" + " | ".join(filter(None, map(inner, _CELL.findall(m[1])))) + "\n", text)
        text = _HEADING.sub(lambda m: f"\n{'#' * int(m[1])} {inner(m[2])}\n", text)
        text = _TAG.sub("", _BREAK.sub("\n", _ITEM.sub(lambda m: f"\n- {inner(m[1])}\n", text)))
    text = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", _decoded(text)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(StringType())
def html_to_text(markup: pd.Series) -> pd.Series:
    """Structured text of pages, see ``structured_text``; scripts, styles and navigation are left out. Null stays null."""
    return markup.map(structured_text, na_action="ignore")


#: Tokens of the size estimate, and scripts without blanks, of which two characters count as one.
ESTIMATE = rf"[\x{{3400}}-\x{{9FFF}}]|[\p{{L}}\p{{N}}]+|[^{SPACES}\p{{L}}\p{{N}}_]"
UNSPACED = r"[\x{0E00}-\x{0E7F}\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{31F0}-\x{31FF}\x{AC00}-\x{D7AF}]+"


def estimated_tokens(text: Column) -> Column:
    """A rough size: Han characters that begin a word singly, words of letters as one, runs of kana, Hangul or Thai by halves; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    halves = F.aggregate(F.regexp_extract_all(text, F.lit(UNSPACED), F.lit(0)), F.lit(0), lambda n, run: (n + F.ceil(F.length(run) / 2)).cast("int"))
    return F.regexp_count(F.regexp_replace(text, UNSPACED, " "), F.lit(ESTIMATE)) + halves


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t).casefold() if not unicodedata.combining(c)), na_action="ignore")


def folded_identity(text: Column) -> Column:
    """A name in compatibility form, without case and marks."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _folded(text)).otherwise(F.lower(text))


def is_resume(name: Column) -> Column:
    """Whether a name or title marks a résumé."""
    return F.coalesce(folded_identity(name).rlike(r"(?<![a-z0-9])(?:resume|cv|curriculum[\s_-]+vitae)(?![a-z0-9])|简历"), F.lit(False))
