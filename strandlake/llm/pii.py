"""Problem 2: personal information in free text, found by a character BiLSTM-CRF and replaced by typed placeholders.

Every text is cut into windows of WINDOW characters that overlap by OVERLAP, and the tagger decodes each window. All
mentions of all windows of a text then compete at once: those that a window's end cuts are joined with their rest in
the next window, equal ones of two windows are one, every mention weighs its length times how well its window knows it
(the further from the window's ends, the better, and two windows more than one), and the set of mentions without
overlaps that weighs most over the whole text is kept. Each mention is then fitted to the characters (whole words for
names, the whole address for mail, all digits of a number); what has not the makings of its kind is dropped.

Defined results: null stays null, empty and blank texts have no mentions; repeated texts give repeated mentions;
mentions never overlap; positions are code points of the stored text; other columns are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import read_table
from strandlake.llm.pii_model import KINDS, Tagger, char_classes, spans_of

#: Characters of a window and of the overlap of neighbours; windows decoded at once.
WINDOW, OVERLAP, BATCH = 640, 64, 1024
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

_MAIL = re.compile(r"[\w.+'\-]+(?:[@＠]|\s[@＠]\s|\s?[(\[]\s?(?:at|AT|At)\s?[)\]]\s?|\sat\s)[\w\-]+(?:(?:\.|．|\s?[(\[]\s?(?:dot|DOT|Dot)\s?[)\]]\s?|\sdot\s)[\w\-]+)+", re.A)
_NUMBER = re.compile(r"[+＋(（]?[\d０-９](?:[\d０-９]|[ ()/.\-    ‑－]{1,2}(?=[\d０-９(]))+[\d０-９]?")
_ID = re.compile(r"(?<![^\W_一-鿿])(?:[A-Z]{1,2}[  ]?)?[\dA-Z０-９Ｘ](?:[\dA-Z０-９Ｘ]|[ \-    ](?=[\dA-Z０-９]))+")
_WORD = re.compile(r"[^\W\d_]")
_DIALLED = re.compile(r"\+|00\d|\d{3}[-.]\d{4}$")
_DATE_ONLY = re.compile(r"[^\W\d]{3,10}\.? (?:19|20)\d\d")
#: Small words inside names.
PARTICLES = frozenset("van von de der den da di del la le bin al y e".split())


def windows_of(length: int) -> list[tuple[int, int]]:
    """Begin and end of the windows of a text."""
    step = WINDOW - OVERLAP
    last = max(0, -(-(length - OVERLAP) // step) - 1) if length > WINDOW else 0
    return [(k * step, min(length, k * step + WINDOW)) for k in range(last + 1)]


def reconcile(found: list[tuple[int, int, list[tuple[int, int, str]]]]) -> list[tuple[int, int, str]]:
    """Mentions of a text from (begin, end, mentions) of its windows in order: the heaviest set without overlaps."""
    if len(found) < 2:
        return found[0][2] if found else []
    weights: dict[tuple[int, int, str], float] = {}
    open_: list[tuple[int, int, str, float]] = []  # mentions that the end of the last window cuts
    last = found[-1][1]
    for begin, end, mentions in found:
        cut, joined = [], set()
        for a, b, kind in mentions:
            near = min(a - begin if begin else OVERLAP, end - b if end < last else OVERLAP)
            weight = (b - a) * (1 + min(near, OVERLAP) / OVERLAP)
            for k, (a0, b0, kind0, weight0) in enumerate(open_):
                if kind0 == kind and a <= b0 and a0 < b:  # its rest: the next window knows where it ends
                    a, weight = min(a, a0), weight + weight0
                    joined.add(k)
            if b == end < last:
                cut.append((a, b, kind, weight))
            else:
                weights[a, b, kind] = weights.get((a, b, kind), 0.0) + weight
        for k, (a, b, kind, weight) in enumerate(open_):
            if k not in joined:
                weights[a, b, kind] = weights.get((a, b, kind), 0.0) + weight
        open_ = cut
    for a, b, kind, weight in open_:
        weights[a, b, kind] = weights.get((a, b, kind), 0.0) + weight
    spans = sorted(weights, key=lambda m: (m[1], m[0], m[2]))
    ends = [m[1] for m in spans]
    best: list[tuple[float, int]] = [(0.0, 0)]  # the weight of the first k mentions, and how many precede the last one taken
    for k, span in enumerate(spans):
        before = bisect_right(ends, span[0], hi=k)
        taken = best[before][0] + weights[span]
        best.append((taken, before) if taken > best[k][0] else (best[k][0], -1))
    out, k = [], len(spans)
    while k:
        if best[k][1] >= 0:
            out.append(spans[k - 1])
            k = best[k][1]
        else:
            k -= 1
    return out[::-1]


def _ends_word(letter: str) -> bool:
    return letter.isspace() or "\u3000" <= letter < "\uff00"


def longest_match(pattern: re.Pattern, text: str, begin: int, end: int) -> tuple[int, int] | None:
    """The longest match that shares characters with begin..end, however long it is.

    The search starts around the mention, from white space or a Chinese character to another, and widens while a match reaches its bounds.
    """
    reach = 48
    while True:
        low, high = max(0, begin - reach), min(len(text), end + reach)
        while low and not _ends_word(text[low - 1]):
            low -= 1
        while high < len(text) and not _ends_word(text[high]):
            high += 1
        best = None
        for match in pattern.finditer(text, low, high):
            if match.start() < end and match.end() > begin and (best is None or match.end() - match.start() > best[1] - best[0]):
                best = match.span()
        if not best or (best[0] > low or not low) and (best[1] < high or high == len(text)):
            return best
        reach *= 4


def fit(text: str, begin: int, end: int, kind: str) -> tuple[int, int] | None:
    """A mention fitted to the characters around it; None if it can't be one of its kind."""
    if kind == "email":
        return longest_match(_MAIL, text, begin, end)
    if kind == "phone":
        span = longest_match(_NUMBER, text, begin, end)
        digits = sum(c.isdigit() for c in text[span[0] : span[1]]) if span else 0
        return span if span and 7 <= digits <= 16 else None
    if kind == "id_number":
        span = longest_match(_ID, text, begin, end)
        if span and span[0] < begin and text[begin - 1].isspace() and not any(c.isdigit() for c in text[span[0] : begin]):
            span = (begin, span[1])  # a word before the number
        return span if span and sum(c.isdigit() for c in text[span[0] : span[1]]) >= 5 else None
    while begin < end and not (text[begin].isalnum()):
        begin += 1
    while end > begin and not (text[end - 1].isalnum() or kind == "name" and text[end - 1] == "."):
        end -= 1
    if begin >= end or not any(c.isalpha() for c in text[begin:end]):
        return None
    han = all("㐀" <= c <= "鿿" for c in text[begin:end])
    if kind == "address":
        while begin and text[begin - 1].isalnum() and text[begin - 1] < "　" and text[begin] < "　":
            begin -= 1
        return (begin, end) if any(c.isdigit() for c in text[begin:end]) and not _DATE_ONLY.fullmatch(text[begin:end]) else None
    if not han:
        while begin and (_WORD.match(text[begin - 1]) or text[begin - 1] in "'’-" and begin > 1 and _WORD.match(text[begin - 2])) and text[begin - 1] < "　":
            begin -= 1
        while end < len(text) and (_WORD.match(text[end]) or text[end] in "'’-" and end + 1 < len(text) and _WORD.match(text[end + 1])) and text[end] < "　":
            end += 1
        initial = re.search(r"(?<![^\W\d_])[A-Z]\. ?$", text[max(0, begin - 4) : begin])
        if initial:
            begin -= len(initial.group())
        words = list(re.finditer(r"[^\W\d_]+", text[begin:end]))
        if any(w.group()[0].isupper() for w in words):  # small words at the ends belong to the sentence
            while words and words[-1].group()[0].islower():
                words.pop()
            while words and words[0].group()[0].islower() and words[0].group() not in PARTICLES:
                words.pop(0)
            if not words:
                return None
            stop = end if words[-1].end() + 1 == end - begin and text[end - 1] == "." else begin + words[-1].end()
            begin, end = begin + words[0].start(), stop
        small = [w.group()[0].islower() for w in words if w.group().lower() not in PARTICLES]
        return (begin, end) if len(words) >= 2 and not any(c.isdigit() for c in text[begin:end]) and (all(small) or not any(small)) else None
    heading = text[begin - 1 : begin] in ("", "\n") and text[end : end + 1] in ("", "\n")  # two characters alone on a line
    return (begin, end) if 2 <= end - begin <= 4 and not (heading and end - begin == 2) else None


def find_mentions(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) of the mentions of each text, in order."""
    jobs, coded = [], {}
    for k, text in enumerate(texts):
        if text and not text.isspace():
            coded[k] = char_classes(text)
            jobs += [(b - a, k, a, b) for a, b in windows_of(len(text))]
    jobs.sort()
    raw: dict[int, list[tuple[int, int, list[tuple[int, int, str]]]]] = {k: [] for k in coded}
    for at in range(0, len(jobs), BATCH):
        batch = jobs[at : at + BATCH]
        classes = np.zeros((batch[-1][0], len(batch)), np.intp)
        for column, (size, k, a, b) in enumerate(batch):
            classes[:size, column] = coded[k][a:b]
        paths = tagger.decode(classes, np.array([j[0] for j in batch]))
        tagged = paths.any(axis=0)
        for column, (size, k, a, b) in enumerate(batch):
            raw[k].append((a, b, spans_of(paths[:size, column], a) if tagged[column] else []))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, found in raw.items():
        text, last = texts[k], 0
        for begin, end, kind in reconcile(sorted(found, key=lambda f: f[0])):
            span = fit(text, begin, end, kind)
            if kind == "id_number" and span and _DIALLED.match(text[span[0] : span[1]]):
                kind, span = "phone", fit(text, *span, "phone")  # no identity number is written so
            if not span or span[0] < last:
                continue
            if kind == "address" and out[k] and out[k][-1][2] == kind and span[0] - last <= 3 and not any(c.isalnum() for c in text[last : span[0]]):
                out[k][-1] = (out[k][-1][0], span[1], kind)  # the parts of one address
            else:
                out[k].append((*span, kind))
            last = span[1]
    return out


def redact_text(text: str | None, mentions: list[tuple[int, int, str]]) -> str | None:
    """The text with every mention replaced by the placeholder of its kind."""
    if not mentions:
        return text
    parts, last = [], 0
    for begin, end, kind in mentions:
        parts += [text[last:begin], PLACEHOLDERS[kind]]
        last = end
    return "".join([*parts, text[last:]])


_tagger: list[Tagger] = []


def mentions_udf(weights: str | None = None) -> Callable[[Column], Column]:
    """A column function text -> mentions and the redacted text. The weights are a file of this package (under 0.3 MB)."""

    @F.pandas_udf("mentions array<struct<start_pos bigint, end_pos bigint, kind string>>, redacted string")
    def of(texts: pd.Series) -> pd.DataFrame:
        if not _tagger:
            _tagger.append(Tagger.load(weights))
        values = texts.tolist()
        found = find_mentions(_tagger[0], values)
        return pd.DataFrame({
            "mentions": [[{"start_pos": a, "end_pos": b, "kind": kind} for a, b, kind in m] for m in found],
            "redacted": [redact_text(t, m) for t, m in zip(values, found, strict=True)],
        })

    return of


def personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, doc_key and text of the three tables."""
    read = lambda table, column: read_table(spark, sf_dir, table).select(F.lit(table).alias("src"), F.col("doc_id").cast("string").alias("doc_key"), F.col(column).alias("text"))
    return read("documents", "text").unionByName(read("catalog_documents", "body")).unionByName(read("portfolio_docs", "body"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its mentions replaced, and how many there were."""
    found = personal_texts(spark, sf_dir).select("src", "doc_key", mentions_udf()("text").alias("m"))
    return found.select("src", "doc_key", F.col("m.redacted").alias("text"), F.size("m.mentions").alias("mentions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_texts(spark, sf_dir).select("src", "doc_key", F.explode(mentions_udf()("text")["mentions"]).alias("m"))
    return found.select("src", "doc_key", F.col("m.kind").alias("pii_kind"), F.col("m.start_pos").alias("start_pos"))
