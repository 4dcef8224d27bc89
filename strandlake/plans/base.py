"""Registration of queries, tables that several of them read, and SQL pieces that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import read_table
from strandlake.operators import catalog, retrieval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: SQL pieces with {x} for a column; the class of white space is spelled out as in functions.text.
_SPACES = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BUDGET = rf"[A-Za-z0-9][A-Za-z0-9.+#:_/-]*|[\x{{3400}}-\x{{9fff}}]|[^{_SPACES}A-Za-z0-9\x{{3400}}-\x{{9fff}}]"
_TOKENS = "len(regexp_extract_all({x}, '" + _BUDGET + "'))"
_SEARCH = r"""list_concat(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9][a-z0-9.+#:_/-]*'),
  flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[\x{3400}-\x{9fff}]+'), lambda r: list_concat(list_transform(range(1, len(r) + 1), lambda k: substr(r, k::bigint, 1)), list_transform(range(1, len(r)), lambda k: substr(r, k::bigint, 2))))))"""


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _documents(spark, sf_dir).filter("doc_id % 50 = 0 and length(title) > 0")
    return asked.select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk once, as last written, with its document's title."""
    rows = read_table(spark, sf_dir, "chunks").filter("chunk_id is not null")
    titles = read_table(spark, sf_dir, "catalog_documents").select("doc_id", "title")
    return catalog.keep_last(rows, "chunk_id", "updated_at", "content_hash", "raw_body").join(titles, "doc_id", "left")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: the users' messages with an id divisible by 50, deliveries counted once (query_id, question, space_id)."""
    rows = read_table(spark, sf_dir, "chat_history").filter("msg_role = 'user' and message_id % 50 = 0 and length(trim(content)) > 0 and space_id is not null")
    return rows.groupBy(F.col("message_id").alias("query_id")).agg(F.min("content").alias("question"), F.min("space_id").alias("space_id"))


#: SQL of ``chunk_rows`` (with txt, what is searched) and ``messages``.
CHUNK_SQL = """ch as (select c.*, d.title, concat_ws(' ', d.title, c.raw_body) as txt from (select *, row_number() over (partition by chunk_id order by updated_at desc, content_hash desc, raw_body desc) as n from chunks where chunk_id is not null) c left join catalog_documents d using (doc_id) where n = 1),
ask as (select message_id as query_id, min(content) as question, min(space_id) as space_id from chat_history where msg_role = 'user' and message_id % 50 = 0 and length(trim(content)) > 0 and space_id is not null group by 1)"""


def any_marker(column: str, markers: tuple[str, ...]) -> str:
    """SQL for whether any marker occurs in a column, case ignored."""
    return "(" + " or ".join(f"contains(lower({column}), '{m}')" for m in markers) + ")"


def _sections(question: str) -> dict[str, str]:
    tests = {section: any_marker(question, markers) for section, markers in retrieval.SECTIONS.items()}
    tests["project"] = f"({tests['project']} or (contains({question}, '项目') and {any_marker(question, ('哪些', '哪个', '项目经验', '体现'))}))"
    return tests


def section_value(section: str, question: str) -> str:
    """SQL for what a section adds to a score, given the question."""
    tests = _sections(question)
    named = "(" + " or ".join(tests.values()) + ")"
    return f"(case coalesce({section}, 'document') " + " ".join(f"when '{s}' then (case when {test} then 0.12 else 0.0 end)" for s, test in tests.items()) + f" when 'profile' then (case when {named} then -0.03 else 0.0 end) when 'summary' then (case when {named} then -0.03 else 0.0 end) else 0.0 end)"
