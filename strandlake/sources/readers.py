"""Sources: JSON arrays, CSV records, folders of files, Office documents. All give rows of one shape: title, body, ...

Files come from Spark's own readers; Python decodes one file at a time, in the task that has it. Sizes and names are
tested on the listing, and files that fail the tests are never read.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.text import detect_language, file_stem, html_to_text, markdown_title

ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")
TEXT_ENDS, MOST_TEXT_BYTES, MOST_FILE_BYTES, MOST_UPLOAD_BYTES = ("md", "markdown", "txt", "csv", "json"), 900_000, 20_000_000, 4_000_000
RECORD_ENDS, UPLOAD_ENDS = ("json", "csv", "md", "markdown", "txt", "docx"), ("pdf", "docx", "md", "markdown", "txt", "csv")
#: Folders that a scan leaves out.
SKIPPED = r"/(?:\.git|node_modules|__pycache__|\.venv)/"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON array; a file that holds anything else is an error."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("first"))
    if head.filter("first <> '['").limit(1).count():
        raise ValueError(f"{path} doesn't hold a JSON array")
    return spark.read.json(path, multiLine=True)


def decode(content: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


def docx_paragraphs(content: bytes) -> Iterator[tuple[str, str]]:
    """(style, text) of the paragraphs of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        root = ElementTree.fromstring(file.read("word/document.xml"))
    for paragraph in root.iter(f"{_WORD}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{_WORD}t")).strip()
        style = paragraph.find(f"{_WORD}pPr/{_WORD}pStyle")
        if text:
            yield (style.get(f"{_WORD}val", "") if style is not None else ""), text


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word file, joined by empty lines."""
    return "\n\n".join(text for _, text in docx_paragraphs(content))


def docx_html(content: bytes) -> str:
    """A Word file as simple markup: headings by their style, everything else a paragraph."""
    from html import escape

    tag = lambda style: f"h{style[-1]}" if style.lower().startswith("heading") and style[-1:] in "123456" else "p"
    return "".join(f"<{tag(style)}>{escape(text, quote=False)}</{tag(style)}>" for style, text in docx_paragraphs(content))


def csv_rows(text: str) -> list[dict[str, str]]:
    """Records by the names of the header; values beyond it are left out, missing ones are empty."""
    return [{k: v or "" for k, v in row.items() if k is not None} for row in csv.DictReader(io.StringIO(text))]


def records_of(stem: str, kind: str, content: bytes) -> list[tuple[str | None, str | None, str | None]]:
    """(title, body, visibility) of every record of a file: each JSON row, each CSV row, or the whole text."""
    if kind == "json":
        payload = json.loads(content.decode("utf-8-sig"))
        rows = payload if isinstance(payload, list) else [payload]
        return [(r.get("title"), r.get("body"), r.get("visibility") or (r.get("metadata") or {}).get("visibility")) for r in rows]
    if kind == "csv":
        rows = csv_rows(content.decode("utf-8-sig"))
        return [(r.get("title") or f"{stem} row {k}", r.get("body") or " | ".join(f"{name}: {value}" for name, value in r.items()), None) for k, r in enumerate(rows, 1)]
    return [(stem, docx_text(content) if kind == "docx" else content.decode("utf-8-sig"), None)]


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder or of a pattern: path, file_name, file_type (the ending), length and content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\+", "%2B"))
    return found.select("path", name.alias("file_name"), F.lower(F.regexp_extract("path", r"[^/.]\.([^./]+)$", 1)).alias("file_type"), "length", "content")


def sized(found: DataFrame, most: int, *, kinds: tuple[str, ...] = (), most_of_kinds: int = 0) -> tuple[DataFrame, DataFrame]:
    """(files within their limit, listing of those beyond): two scans, and only the first one reads contents.

    Files of ``kinds`` have a limit of their own.
    """
    limit = F.when(F.col("file_type").isin(*kinds), most_of_kinds).otherwise(most) if kinds else F.lit(most)
    return found.filter(F.col("length") <= limit), found.drop("content").filter(F.col("length") > limit)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files as a document (title, body, visibility, source, file_type, row_no), faulty files as a row with ``error``.

    Endings other than RECORD_ENDS are unsupported_file, what can't be decoded or parsed invalid_file.
    """
    found = files(spark, path).withColumn("stem", file_stem(F.col("file_name")))
    known = found.filter(F.col("file_type").isin(*RECORD_ENDS))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, kind, stem, content in frame.itertuples(index=False):
                try:
                    rows += [(name, kind, k, title, body, visibility, None) for k, (title, body, visibility) in enumerate(records_of(stem, kind, content), 1)]
                except Exception:  # noqa: BLE001
                    rows.append((name, kind, None, None, None, None, "invalid_file"))
            yield pd.DataFrame(rows, columns=["source", "file_type", "row_no", "title", "body", "visibility", "error"])

    schema = "source string, file_type string, row_no int, title string, body string, visibility string, error string"
    made = known.select("file_name", "file_type", "stem", "content").mapInPandas(parse, schema)
    text = lambda name: F.lit(None).cast("string").alias(name)
    other = found.filter(~F.col("file_type").isin(*RECORD_ENDS)).select(F.col("file_name").alias("source"), "file_type", F.lit(None).cast("int").alias("row_no"), text("title"), text("body"), text("visibility"), F.lit("unsupported_file").alias("error"))
    return made.unionByName(other)


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Each record of CSV files as a document: its title and body columns, or "name: value | ..." of all fields in header order."""
    made = read_records(spark, path).filter("file_type = 'csv' and error is null")
    return made.select("title", "body", F.regexp_replace("source", r"\.[^.]*$", "").alias("file_stem"), "row_no")


def read_uploads(spark: SparkSession, path: str, least_chars: int = 1) -> DataFrame:
    """Uploaded files as published texts: title, body, language, size, or an ``error``.

    Errors: unsupported_file, empty_file, file_too_large, invalid_file (a Word file that isn't one), needs_ocr (PDF, which
    no library here reads). CSV becomes one text with a paragraph of "name: value" lines for each record, Word files go
    through markup. Texts are whole. Files of no bytes at all aren't in Spark's listing and so give no row.
    """
    found = files(spark, path)
    fits, large = sized(found.filter(F.col("file_type").isin(*UPLOAD_ENDS)), MOST_UPLOAD_BYTES)
    columns = ["file_name", "file_type", "size_bytes", "text", "markup", "error"]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, kind, size, content in frame.itertuples(index=False):
                text = markup = error = None
                try:
                    if kind == "docx":
                        markup = docx_html(content)
                    elif kind == "csv":
                        text = "\n\n".join("\n".join(f"{k}: {v.strip()}" for k, v in row.items()) for row in csv_rows(content.decode("utf-8-sig", "replace")) if any(v.strip() for v in row.values()))
                    elif kind == "pdf":
                        error = "needs_ocr" if content.startswith(b"%PDF") else "invalid_file"
                    else:
                        text = content.decode("utf-8-sig", "replace")
                except Exception:  # noqa: BLE001
                    error = "invalid_file"
                rows.append((name, "md" if kind == "markdown" else kind, size, text, markup, error))
            yield pd.DataFrame(rows, columns=columns)

    schema = "file_name string, file_type string, size_bytes long, text string, markup string, error string"
    read = fits.select("file_name", "file_type", "length", "content").mapInPandas(parse, schema)
    plain = F.regexp_replace(F.translate(F.coalesce("text", html_to_text(F.col("markup")), F.lit("")), "\u0000", ""), r"\r\n?", "\n")
    read = read.withColumn("body", F.regexp_replace(plain, r"^\s+|\s+$", "")).withColumn("error", F.coalesce("error", F.when(F.length("body") < least_chars, "empty_file")))
    fault = lambda df, error: df.select("file_name", "file_type", F.col("length").alias("size_bytes"), F.lit("").alias("body"), F.lit(error).alias("error"))
    every = reduce(DataFrame.unionByName, [read.drop("text", "markup"), fault(large, "file_too_large"), fault(found.drop("content").filter(~F.col("file_type").isin(*UPLOAD_ENDS)), "unsupported_file")])
    stem = file_stem(F.col("file_name"))
    title = F.when(F.col("file_type").isin("md", "docx"), markdown_title(F.col("body"), stem)).otherwise(stem)
    return every.withColumn("title", title).withColumn("language", detect_language(F.col("body")))


def scan_folder(spark: SparkSession, path: str, least_chars: int = 80, most_chars: int | None = None) -> DataFrame:
    """Files below a folder with their texts and a status: ready, needs_ocr, too_large, parse_error, short or truncated.

    Texts are whole unless ``most_chars`` is given; those that it cuts are truncated. Files beyond their size limit are
    listed as too_large and never read.
    """
    found = files(spark, path).filter(~F.col("path").rlike(SKIPPED))
    fits, large = sized(found, MOST_FILE_BYTES, kinds=TEXT_ENDS, most_of_kinds=MOST_TEXT_BYTES)
    readers: dict[str, Callable[[bytes], str]] = dict.fromkeys(TEXT_ENDS, decode) | {"docx": docx_text}

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_path, kind, size, content in frame.itertuples(index=False):
                text, status = "", "ready" if kind in readers else "needs_ocr"
                try:
                    text = readers[kind](content) if kind in readers else ""
                except Exception as error:  # noqa: BLE001
                    status = f"parse_error: {type(error).__name__}"
                if status == "ready" and len(text.strip()) < least_chars:
                    status = "short"
                if most_chars is not None and len(text) > most_chars:
                    text, status = text[:most_chars], "truncated"
                rows.append((file_path, kind, size, text, status))
            yield pd.DataFrame(rows, columns=["path", "file_type", "size_bytes", "body", "parse_status"])

    schema = "path string, file_type string, size_bytes long, body string, parse_status string"
    read = fits.select("path", "file_type", "length", "content").mapInPandas(texts, schema)
    return read.unionByName(large.select("path", "file_type", F.col("length").alias("size_bytes"), F.lit("").alias("body"), F.lit("too_large").alias("parse_status")))


#: What a benchmark case may say.
CASE_SCHEMA = "case_id string, category string, language string, question string, expected_doc_ids array<string>, relevance map<string,int>, should_answer boolean, scope string"


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases of a JSON array. Repeated ids, unknown languages or scopes, and answerable cases without documents are errors."""
    read_json_array(spark, path)
    cases = spark.read.schema(CASE_SCHEMA).json(path, multiLine=True)
    faults = {
        "unsupported language": ~F.coalesce(F.col("language").isin("zh", "en"), F.lit(False)),
        "unsupported scope": ~F.coalesce(F.col("scope").isin("public", "all"), F.lit(False)),
        "no expected documents": F.coalesce("should_answer", F.lit(False)) & (F.coalesce(F.size("expected_doc_ids"), F.lit(0)) <= 0),
    }
    found = cases.select("case_id", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in faults.items())))).alias("fault"))
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("case_id", F.lit("repeated id").alias("fault"))
    first = found.unionByName(repeated).orderBy("case_id", "fault").first()
    if first:
        raise ValueError(f"case {first.case_id}: {first.fault}")
    return cases
