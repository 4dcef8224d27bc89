"""The registered queries of the reference's operators, each with the SQL that says the same.

Every query reads whole tables. Searches take every document whose id is divisible by 50 as a question (its title)
and search all documents; vector searches likewise. Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.common import read_table, written
from strandlake.functions import keys
from strandlake.functions import text as T
from strandlake.operators import catalog, chunking, evaluate, retrieval, versions
from strandlake.plans import prompt
from strandlake.streaming import rate

from strandlake.plans.base import _BUDGET, _SEARCH, _SPACES, _TOKENS, QUERIES, SQL, Query, _documents, _questions, any_marker, chunk_rows, register

# --- texts -------------------------------------------------------------------------------------------------------


@register(f"select doc_id, {_TOKENS.replace('{x}', 'text')}::bigint as tokens, length(text)::bigint as chars from documents where text is not null")
def text_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).filter("text is not null").select("doc_id", T.count_tokens(F.col("text")).alias("tokens"), F.length("text").cast("bigint").alias("chars"))


_WHITE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[\t\f\x0b ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[S]+|[S]+$', '', 'g')""".replace("[S]", f"[{_SPACES}]")


@register(f"select doc_id, sha256({_WHITE.replace('{x}', 'text')}) as clean_hash from documents where text is not null")
def text_clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).filter("text is not null").select("doc_id", F.sha2(T.normalize_whitespace(F.col("text")), 256).alias("clean_hash"))


@register()
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup, entities, mail and web addresses out of every catalog body."""
    cleaned = T.clean_text(F.col("body"), urls=True, emails=True)
    return read_table(spark, sf_dir, "catalog_documents").select("doc_id", cleaned.alias("body"))


@register(r"""select doc_id, case when len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) >= greatest(3.0, length(text) * 0.05) then 'zh' else 'en' end as detected from documents where text is not null""")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).filter("text is not null").select("doc_id", T.detect_language(F.col("text")).alias("detected"))


@register(r"""select doc_id, (regexp_matches(lower(url), '^https?://[^/?#\s]+'))::boolean as valid, try_cast(regexp_extract(updated, '(20\d{2})', 1) as integer) * 10000.0 + try_cast(regexp_extract(updated, '20\d{2}-(\d{2})', 1) as integer) * 100 + try_cast(regexp_extract(updated, '20\d{2}-\d{2}-(\d{2})', 1) as integer) as updated_number
from portfolio_docs where url is not null""")
def url_and_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "portfolio_docs").filter("url is not null")
    return rows.select("doc_id", T.valid_http_url(F.col("url")).alias("valid"), T.date_number(F.col("updated")).alias("updated_number"))


@register(r"""select doc_id, (regexp_matches(coalesce(body, ''), '(^|[^\d])\d{17}[\dXx]($|[^\d])'))::boolean as has_national_id from catalog_documents""")
def national_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "catalog_documents").select("doc_id", F.array_contains(T.public_pii_kinds(F.col("body")), "national_id").alias("has_national_id"))


@register()
def pii_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "catalog_documents")
    return rows.select("doc_id", F.array_join(T.local_pii_kinds(F.col("body")), ",").alias("local_kinds"), F.array_join(T.public_pii_kinds(F.col("body")), ",").alias("public_kinds"))


@register()
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "catalog_documents")
    title = T.markdown_title(F.col("body"), F.coalesce(F.col("title"), F.lit("")))
    return rows.select("doc_id", title.alias("title"), T.version_title_key(F.coalesce("title", F.lit(""))).alias("version_key"), T.slugify(F.coalesce("title", F.lit(""))).alias("slug"), T.is_mojibake(F.col("body")).alias("mojibake"))


# --- identities, duplicates, versions ------------------------------------------------------------------------------


@register("""select doc_id, sha256(text) as content_hash, 'doc_' || substr(sha256(coalesce(title, '') || chr(10) || sha256(text)), 1, 20) as key from documents where text is not null""")
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).filter("text is not null")
    return rows.select("doc_id", keys.content_hash(F.col("text")).alias("content_hash"), keys.document_id(F.col("title"), F.col("text")).alias("key"))


@register("""select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_id, max(doc_id) as last_id from documents where text is not null group by 1 having count(*) > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).filter("text is not null")
    return catalog.duplicate_groups(rows.select("doc_id", keys.content_hash(F.col("text")).alias("content_hash")))


@register("""select doc_id, source from (select *, row_number() over (partition by sha256(text) order by doc_id) as n from documents where text is not null) where n = 1""")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).filter("text is not null").select("doc_id", "source", keys.content_hash(F.col("text")).alias("h"))
    return catalog.keep_first(rows, "h", "doc_id").select("doc_id", "source")


@register("""select doc_id, space_id from (select *, row_number() over (partition by content_hash order by updated_at desc, doc_id desc) as n from catalog_documents where content_hash <> '') where n = 1""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "catalog_documents").filter("content_hash <> ''").select("doc_id", "space_id", "content_hash", "updated_at")
    return catalog.keep_last(rows, "content_hash", "updated_at", "doc_id").select("doc_id", "space_id")


@register("""select version_group_id, max_by(doc_id, coalesce(modified_at, '') || chr(31) || coalesce(updated_at, '') || chr(31) || doc_id) as doc_id, count(*) as members from catalog_documents where version_group_id is not null group by 1""")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_versions(read_table(spark, sf_dir, "catalog_documents"))


@register()
def version_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active uploads of one space and like titles, similar to another by shared words and stretches, in groups."""
    return versions.version_members(catalog.version_inputs(read_table(spark, sf_dir, "catalog_documents")))


# --- chunks --------------------------------------------------------------------------------------------------------

_WINDOWS = "unnest(range(0, case when length(text) <= 800 then 1 else ceil((length(text) - 800) / 720.0)::bigint + 1 end))"


@register(f"""select doc_id, k::integer as chunk_index, sha256(substr(text, k * 720 + 1, 800)) as chunk_hash from (select doc_id, text, {_WINDOWS} as k from documents where length(text) > 0)""")
def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.fixed_windows(_documents(spark, sf_dir).select("doc_id", "text"), "text")
    return made.select("doc_id", "chunk_index", F.sha2("chunk_body", 256).alias("chunk_hash"))


@register(f"""with c as (select doc_id, substr(text, k * 720 + 1, 800) as b from (select doc_id, text, {_WINDOWS} as k from documents where length(text) > 0)),
g as (select doc_id, count(*) as chunks, round_even(avg(length(b)), 0)::bigint as average_length, min(length(b))::integer as min_length, max(length(b))::integer as max_length, sum({_TOKENS.replace('{x}', 'b')})::bigint as tokens, sum((length(b) < 100)::integer)::bigint as short_chunks from c group by 1)
select *, short_chunks >= 0.25 * chunks as many_short, max_length > 1600 as too_long from g""")
def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunk_metrics(chunking.fixed_windows(_documents(spark, sf_dir).select("doc_id", "text"), "text"))
    return made.select("doc_id", "chunks", "average_length", "min_length", "max_length", "tokens", "short_chunks", "many_short", "too_long")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "catalog_documents").select("doc_id", "title", "body")


@register()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.split_bodies(_bodies(spark, sf_dir).drop("title"))
    return made.select("doc_id", "chunk_index", keys.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk_body")).alias("chunk_id"), F.length("chunk_body").alias("chars"))


@register()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_bodies(_bodies(spark, sf_dir), mode="markdown", size=200, overlap=0).select("doc_id", "chunk_index", F.sha2("chunk_body", 256).alias("chunk_hash"))


@register()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_bodies(_bodies(spark, sf_dir), mode="paragraph", size=120, overlap=0).select("doc_id", "chunk_index", F.sha2("chunk_body", 256).alias("chunk_hash"))


@register()
def chunk_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.hierarchy(_bodies(spark, sf_dir))
    return made.select("doc_id", "parent_index", "parent_chunk_id", "child_index", "chunk_id", "token_count", "character_count")


@register("""select doc_id, '[' || concat_ws(' | ', case when trim(coalesce(title, '')) <> '' then 'Document: ' || title end, case when trim(coalesce(project, '')) <> '' then 'Project: ' || project end, case when trim(coalesce(source, '')) <> '' then 'Source: ' || source end, case when trim(coalesce(updated_at, '')) <> '' then 'Updated: ' || updated_at end) || ']' as prefix from catalog_documents""")
def context_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = chunking.context_prefix(F.col("title"), F.col("project"), F.lit(None).cast("string"), F.col("source"), F.col("updated_at"))
    return read_table(spark, sf_dir, "catalog_documents").select("doc_id", line.alias("prefix"))


@register()
def resume_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).filter("doc_kind = 'resume'").select("doc_id", F.col("text").alias("body"))
    made = chunking.resume_units(rows)
    return made.select("doc_id", "chunk_index", "section_type", "retrieval_priority", "semantic_group_id", F.sha2("raw_body", 256).alias("chunk_hash"))


@register()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.packed_chunks(_bodies(spark, sf_dir))
    return made.select("doc_id", "chunk_index", F.sha2("chunk_body", 256).alias("chunk_hash"), T.count_tokens(F.col("chunk_body")).alias("tokens"))


@register()
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured text of every document, markup in it or not."""
    return _documents(spark, sf_dir).filter("text is not null").select("doc_id", F.sha2(T.html_to_text(F.col("text")), 256).alias("text_hash"))


# --- retrieval -------------------------------------------------------------------------------------------------------

_BM25 = f"""
tok as (select doc_id, {_SEARCH.replace('{x}', 'text')} as t from documents),
tf as (select doc_id, len(t) as length, unnest(t) as term from tok),
post as (select term, doc_id, length, count(*) as tf from tf group by all),
asked as (select query_id, term, count(*) as times from (select doc_id as query_id, unnest({_SEARCH.replace('{x}', 'title')}) as term from documents where doc_id % 50 = 0 and length(title) > 0) group by all),
sizes as (select count(*) as n, greatest(avg(len(t)), 1.0) as avgdl from tok),
dfs as (select term, count(*) as df from post group by 1),
scored as (select query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) as bm25_score
  from post join asked using (term) join dfs using (term), sizes group by all),
ranked as (select *, row_number() over (partition by query_id order by bm25_score desc, doc_id)::integer as bm25_rank from scored where bm25_score > 0)
"""


@register(f"with {_BM25} select query_id, doc_id, bm25_score from ranked where bm25_rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.bm25(_documents(spark, sf_dir), _questions(spark, sf_dir))
    return made.select("query_id", "doc_id", "bm25_score")


@register(f"with {_BM25} select query_id, doc_id, round(bm25_score / max(bm25_score) over (partition by query_id), 6) as score from ranked where bm25_rank <= 10")
def fulltext_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.bm25(_documents(spark, sf_dir), _questions(spark, sf_dir), 10)
    return retrieval.normalize_by_max(made, "bm25_score", "s").select("query_id", "doc_id", F.col("s").alias("score"))


_COSINE = """scored as (select q.vec_id as query_id, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id % 50 = 0)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = read_table(spark, sf_dir, "embeddings")
    return vectors, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@register(f"with {_COSINE} select query_id, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored) where n <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.vector_top_k(*_vectors(spark, sf_dir))
    return made.select("query_id", "vec_id", "score")


@register(f"with {_COSINE} select query_id, label, vec_id, score from (select *, row_number() over (partition by query_id, label order by score desc, vec_id) as n from scored) where n <= 2")
def vector_topk_by_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.vector_top_k(*_vectors(spark, sf_dir), k=2, group="label")
    return made.select("query_id", "label", "vec_id", "score")


@register(f"""with {_COSINE}, top as (select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored) where n <= 20)
select query_id, label, vec_id, score from (select *, row_number() over (partition by query_id, label order by score desc, vec_id) as g from top) where g = 1""")
def diversify_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.vector_top_k(*_vectors(spark, sf_dir), k=20).join(read_table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.diversify(made, "label", "score", "vec_id").select("query_id", "label", "vec_id", "score")


@register(f"""with {_COSINE}, top as (select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored) where n <= 20),
firsts as (select *, case when row_number() over (partition by query_id, label order by score desc, vec_id) = 1 then 0 else 1 end as f from top)
select query_id, label, vec_id, place from (select *, row_number() over (partition by query_id order by f, score desc, vec_id)::integer as place from firsts) where place <= 6""")
def space_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.vector_top_k(*_vectors(spark, sf_dir), k=20).join(read_table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.balance_spaces(made, 6, "score", "label", "vec_id").select("query_id", "label", "vec_id", "place")


_TITLE_RANK = """titles as (select query_id, doc_id, row_number() over (partition by query_id order by len(list_intersect(a, b)) desc, doc_id)::integer as vector_rank from
 (select q.doc_id as query_id, d.doc_id, regexp_extract_all(lower(q.title), '[a-z0-9]+') as a, regexp_extract_all(lower(d.title), '[a-z0-9]+') as b from documents q join ranked r on r.query_id = q.doc_id and r.bm25_rank <= 30 join documents d on d.doc_id = r.doc_id))"""


def _ranked_by_title(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    titles = _documents(spark, sf_dir).select("doc_id", "title")
    both = hits.join(titles, "doc_id").join(_questions(spark, sf_dir), "query_id").withColumn("shared", F.size(F.array_intersect(words("question"), words("title"))))
    return both.withColumn("vector_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("shared").desc(), "doc_id")))


@register(f"""with {_BM25}, {_TITLE_RANK.replace("lower(d.title)", "lower(coalesce(d.title, ''))")},
parts as (select query_id, doc_id, 2.0 / (60 + vector_rank) as p from titles union all select query_id, doc_id, 0.7 / (60 + bm25_rank) from ranked where bm25_rank <= 30),
fused as (select query_id, doc_id, round(sum(p), 6) as fusion_score from parts group by all)
select query_id, doc_id, fusion_score from (select *, row_number() over (partition by query_id order by fusion_score desc, doc_id) as n from fused) where n <= 10""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 fused with a second ranking of the same pool (shared title words) by reciprocal ranks."""
    hits = retrieval.bm25(_documents(spark, sf_dir), _questions(spark, sf_dir), 30)
    fused = retrieval.reciprocal_rank_fusion(_ranked_by_title(spark, sf_dir, hits), hits)
    return retrieval.top_k(fused, "fusion_score", 10, "place").select("query_id", "doc_id", "fusion_score")


@register(f"""with {_BM25}, pool as (select query_id, r.doc_id, bm25_score, q.title as question, lower(coalesce(d.title, '') || ' ' || coalesce(d.text, '')) as s from ranked r join documents q on q.doc_id = r.query_id join documents d on d.doc_id = r.doc_id where bm25_rank <= 10),
boosted as (select query_id, doc_id, bm25_score, least(0.18, 0.06 * len(list_filter(list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9.+#-]{{1,}}'), lambda t: lower(t))), lambda t: contains(s, t) and t not in ('and', 'are', 'for', 'from', 'has', 'have', 'the', 'what', 'which', 'with', 'experience')))) as boost from pool)
select query_id, doc_id, round(boost, 4) as boost from boosted""")
def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25(_documents(spark, sf_dir), _questions(spark, sf_dir), 10)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = hits.join(_documents(spark, sf_dir).select("doc_id", text.alias("searchable")), "doc_id").join(_questions(spark, sf_dir), "query_id")
    made = retrieval.keyword_boost(rows.withColumn("zero", F.lit(0.0)), score="zero")
    return made.select("query_id", "doc_id", F.round("rank_score", 4).alias("boost"))


@register()
def section_and_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section and freshness boosts of every user message's best chunks of its space (BM25 over their bodies).

    Messages of one space and content are searched once.
    """
    asked = read_table(spark, sf_dir, "chat_history").filter("msg_role = 'user' and content is not null and space_id is not null")
    asked = asked.groupBy(F.col("message_id").alias("query_id")).agg(F.min("content").alias("question"), F.min("space_id").alias("space_id"))
    return _boosted_chunks(asked, chunk_rows(spark, sf_dir)).select("query_id", "chunk_id", "section_type", "matched_section_intent", "intent_score", "freshness_score")


def _boosted_chunks(asked: DataFrame, chunks: DataFrame, k: int = 25) -> DataFrame:
    """The best ``k`` chunks of each question (query_id, question, space_id) in its space, with their own sections and dates.

    What the scores need of a chunk comes along with it and is settled once an asking, so that the results are shuffled once.
    """
    asked = written(asked)
    once = written(asked.groupBy("space_id", "question").agg(F.min("query_id").alias("query_id")))
    documents = chunks.select(F.col("chunk_id").alias("doc_id"), "space_id", "raw_body", "section_type", T.date_number(F.date_format("updated_at", "yyyy-MM-dd")).alias("updated_number"))
    who, hits = retrieval.bm25_askings(documents, once, k, "raw_body", "space_id", ("section_type", "updated_number"))
    hits = retrieval.normalize_by_max(hits, "bm25_score", "base", "asking").withColumn("fresh_place", retrieval.fresh_place("updated_number", "asking"))
    asking = asked.join(who.join(once, ["query_id", "space_id"]).drop("query_id"), ["space_id", "question"])
    rows = retrieval.prepared(asking).join(hits.withColumnRenamed("doc_id", "chunk_id"), "asking")
    return retrieval.freshness_boost(retrieval.section_boost(rows, "base"), "intent_score")


_PIECES = r"list_filter(list_transform(regexp_split_to_array(q, '(?i)\b(?:and|versus|vs\.?|compared with)\b|[、，和与]'), lambda p: regexp_replace(p, '^[ ,，。?？]+|[ ,，。?？]+$', '', 'g')), lambda p: length(p) >= 4)"


@register(f"""with m as (select message_id, trim(min(content)) as q from chat_history where msg_role = 'user' and content is not null group by 1),
p as (select *, {any_marker('q', retrieval.COMPLEX)} as complex, list_concat([q], {_PIECES}) as parts from m)
select message_id as query_id, {any_marker('q', retrieval.SENSITIVE)} as refused, {any_marker('q', retrieval.FRESH)} as fresh, complex, array_to_string(case when complex then list_filter(parts, lambda x, i: list_position(parts, x) = i)[1:3] else [q] end, ' || ') as subqueries from p""")
def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "chat_history").filter("msg_role = 'user' and content is not null")
    asked = rows.groupBy(F.col("message_id").alias("query_id")).agg(F.min("content").alias("question"))
    made = retrieval.plan_questions(asked)
    return made.select("query_id", "refused", "fresh", "complex", F.array_join("subqueries", " || ").alias("subqueries"))


_PARTS = _BM25.replace("""asked as (select query_id, term, count(*) as times from (select doc_id as query_id, unnest(""", """words as (select doc_id as query_id, title, regexp_split_to_array(title, '\\s+') as w from documents where doc_id % 50 = 0 and length(title) > 0),
halves as (select query_id, unnest([title, array_to_string(w[1:greatest(1, len(w) // 2)], ' '), array_to_string(w[greatest(1, len(w) // 2) + 1:], ' ')]) as q, unnest([0, 1, 2]) as part from words),
asked as (select query_id, term, count(*) as times from (select query_id * 3 + part as query_id, unnest(""").replace(_SEARCH.replace("{x}", "title") + ") as term from documents where doc_id % 50 = 0 and length(title) > 0)", _SEARCH.replace("{x}", "q") + ") as term from halves)")


@register(f"""with {_PARTS}, merged as (select query_id // 3 as query_id, doc_id, count(*) as hits, max(bm25_score) as bm25_score from ranked where bm25_rank <= 10 group by all)
select query_id, doc_id, hits, bm25_score from (select *, row_number() over (partition by query_id order by hits desc, bm25_score desc, doc_id) as place from merged) where place <= 5""")
def subquery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question and the two halves of its words as subqueries, their results merged by hits and best score."""
    asked = _questions(spark, sf_dir).withColumn("words", F.split("question", r"\s+"))
    half = F.greatest(F.lit(1), F.floor(F.size("words") / 2).cast("int"))
    halves = (F.slice("words", F.lit(1), half), F.slice("words", half + 1, F.size("words")))
    parts = asked.select("query_id", F.posexplode(F.array(F.col("question"), *(F.array_join(h, " ") for h in halves))).alias("part", "question"))
    numbered = parts.withColumn("query_id", F.col("query_id") * 3 + F.col("part"))
    hits = retrieval.bm25(_documents(spark, sf_dir), numbered.select("query_id", "question"), 10)
    back = hits.withColumn("query_id", F.floor(F.col("query_id") / 3))
    return retrieval.merge_subqueries(back, "bm25_score").filter("place <= 5").select("query_id", "doc_id", "hits", "bm25_score")


_SHARE = f"round(len(list_intersect(list_distinct({_SEARCH.replace('{x}', 'q.title')}), list_distinct({_SEARCH.replace('{x}', 'd.text')}))) / greatest(len(list_distinct({_SEARCH.replace('{x}', 'q.title')})), 1)::double, 6)"


@register(f"""with {_BM25}, pool as (select r.query_id, r.doc_id, {_SHARE} as reranker_score from ranked r join documents q on q.doc_id = r.query_id join documents d on d.doc_id = r.doc_id where bm25_rank <= 20)
select query_id, doc_id, reranker_score from (select *, row_number() over (partition by query_id order by reranker_score desc, doc_id) as n from pool) where n <= 5""")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25(_documents(spark, sf_dir), _questions(spark, sf_dir), 20)
    rows = hits.join(_documents(spark, sf_dir).select("doc_id", F.col("text").alias("searchable")), "doc_id").join(_questions(spark, sf_dir), "query_id")
    return retrieval.rerank(rows, 5).select("query_id", "doc_id", "reranker_score")


@register(f"""with {_BM25} select query_id, string_agg('[Source ' || bm25_rank || ': ' || coalesce(d.title, '') || ']' || chr(10) || coalesce(d.text, ''), chr(10) || chr(10) order by bm25_rank) as context, count(*) as sources from ranked r join documents d using (doc_id) where bm25_rank <= 3 group by 1""")
def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25(_documents(spark, sf_dir), _questions(spark, sf_dir), 3).withColumnRenamed("bm25_rank", "place")
    return prompt.contexts(hits.join(_documents(spark, sf_dir).select("doc_id", "title", F.col("text").alias("body")), "doc_id"))


_RELEVANT = """rel as (select q.doc_id as query_id, d.doc_id, case when d.doc_id = q.doc_id then 3 else 1 end as relevance from documents q join documents d on d.title = q.title where q.doc_id % 50 = 0 and length(q.title) > 0)"""


@register(f"""with {_BM25}, {_RELEVANT},
ideal as (select query_id, count(*) as expected, list_sort(list(relevance), 'DESC')[1:5] as best from rel group by 1),
hits as (select r.query_id, r.doc_id, r.bm25_rank as place, coalesce(relevance, 0) as relevance from ranked r left join rel using (query_id, doc_id) where bm25_rank <= 5),
found as (select query_id, count(distinct case when relevance > 0 then doc_id end) as found, min(case when relevance > 0 then place end) as first, sum(relevance / log2(place + 1)) as gain from hits group by 1)
select query_id, case when coalesce(found, 0) > 0 then 1 else 0 end as hit, round(coalesce(found, 0) / expected, 6) as recall, round(coalesce(1 / first, 0.0), 6) as reciprocal_rank,
round(coalesce(gain, 0) / list_sum(list_transform(range(1, len(best) + 1), lambda k: best[k] / log2(k + 1))), 4) as ndcg from ideal left join found using (query_id)""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 judged on finding the documents of the question's own title."""
    asked, documents = _questions(spark, sf_dir), _documents(spark, sf_dir)
    rankings = retrieval.bm25(documents, asked, 5).select("query_id", "doc_id", F.col("bm25_rank").alias("place"))
    relevant = asked.join(documents.select("doc_id", F.col("title").alias("question")), "question").select("query_id", "doc_id", F.when(F.col("doc_id") == F.col("query_id"), 3).otherwise(1).alias("relevance"))
    return evaluate.case_metrics(rankings, relevant, 5).withColumn("ndcg", F.round("ndcg", 4))


@register("""select q.doc_id as query_id, count(*) as violations from catalog_documents q join catalog_documents d on d.title = q.title where q.visibility = 'public' and d.visibility <> 'public' and length(q.title) > 0 group by 1""")
def privacy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "catalog_documents").select("doc_id", "title", "visibility")
    asked = rows.filter("visibility = 'public' and length(title) > 0").select(F.col("doc_id").alias("query_id"), "title")
    return evaluate.privacy_violations(asked.join(rows.select("doc_id", "title"), "title").select("query_id", "doc_id"), rows)


# --- catalog -------------------------------------------------------------------------------------------------------


@register("""select doc_id, title, modified_at from catalog_documents where status = 'active' and visibility = 'public' and contains(lower(coalesce(title, '')), 'notes') order by modified_at desc nulls last, title nulls first, doc_id limit 20 offset 20""")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.matching(read_table(spark, sf_dir, "catalog_documents"), {"status": "active", "visibility": "public", "project": "all"}, "notes", ("title",))
    return catalog.page(rows, 2, 20).select("doc_id", "title", "modified_at")


@register("""select s.space_id, s.status, count(d.doc_id) as documents from knowledge_spaces s left join catalog_documents d using (space_id) group by all""")
def space_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.space_counts(read_table(spark, sf_dir, "catalog_documents"), read_table(spark, sf_dir, "knowledge_spaces")).select("space_id", "status", "documents")


@register("""select doc_id, space_name, sha256(case when summary <> '' then summary else body end) as body_hash from catalog_documents d join knowledge_spaces s using (space_id) where d.status = 'active' and s.status = 'active' and coalesce(nullif(summary, ''), body) is not null""")
def active_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = catalog.active_documents(read_table(spark, sf_dir, "catalog_documents"), read_table(spark, sf_dir, "knowledge_spaces"))
    return made.filter("body is not null").select("doc_id", "space_name", F.sha2("body", 256).alias("body_hash"))


@register("""select count(*) as documents, count(distinct space_id) as spaces, count(version_group_id) as version_members, (select count(*) from (select 1 from catalog_documents where trim(content_hash) <> '' group by content_hash having count(*) > 1)) as duplicate_groups from catalog_documents""")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "catalog_documents")
    totals = rows.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("space_id").alias("spaces"), F.count("version_group_id").alias("version_members"))
    groups = catalog.duplicate_groups(rows).agg(F.count(F.lit(1)).alias("duplicate_groups"))
    return totals.join(groups)  # one row each


@register("""with h as (select doc_id, min(content_hash) as a, max(content_hash) as b from chunks where doc_id is not null group by 1)
select doc_id, case when b is null then 'not_indexed' when a = b and a = content_hash then 'indexed' else 'outdated' end as state from catalog_documents left join h using (doc_id)""")
def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_states(read_table(spark, sf_dir, "catalog_documents"), read_table(spark, sf_dir, "chunks"))


@register("""select project, doc_id, place from (select project, doc_id, row_number() over (partition by project order by relative_path, doc_id)::integer as place from catalog_documents where length(project) > 0) where place <= 2""")
def top_n_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_per_project(read_table(spark, sf_dir, "catalog_documents")).select("project", "doc_id", "place")


@register("""select doc_id, title, updated_at from catalog_documents where status = 'active' and visibility = 'public' and contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), 'notes') order by updated_at desc, doc_id limit 100""")
def public_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.public_search(read_table(spark, sf_dir, "catalog_documents"), "Notes").select("doc_id", "title", "updated_at")


@register("""select chunk_id, doc_id, parent_chunk_id, semantic_group_id, section_type, space_id, sha256(substr(raw_body, 1, 1200)) as snippet_hash from chunks where visibility = 'public' and chunk_id is not null""")
def source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.source_view(read_table(spark, sf_dir, "chunks")).withColumn("snippet_hash", F.sha2("snippet", 256)).drop("snippet")


@register("""select space_id, documents, row_number() over (order by case when space_id = 'portfolio' then 0 else 1 end, space_name, space_id)::integer as place from (select s.space_id, s.space_name, count(d.doc_id) as documents from knowledge_spaces s left join catalog_documents d using (space_id) group by all)""")
def ordered_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = catalog.space_counts(read_table(spark, sf_dir, "catalog_documents"), read_table(spark, sf_dir, "knowledge_spaces"))
    return catalog.ordered_spaces(counted).select("space_id", "documents", "place")


@register("""select doc_id, sha256(processing_profile_json) = processing_profile_hash as hash_matches from catalog_documents where processing_profile_json is not null""")
def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.profile_states(read_table(spark, sf_dir, "catalog_documents"))


_WORDS = "unnest(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+')))"


@register(f"""with {_BM25}, tw as (select doc_id, {_WORDS} as w from documents), qw as (select doc_id as query_id, {_WORDS} as w from documents where doc_id % 50 = 0 and length(title) > 0),
shared as (select query_id, doc_id, count(*) as n from qw join tw using (w) group by all),
titled as (select *, row_number() over (partition by query_id order by n desc, doc_id) as r from shared)
select query_id, channel, count(*) as results from (select query_id, 'vector' as channel from titled where r <= 5 union all select query_id, 'bm25' from ranked where bm25_rank <= 10) group by all""")
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results of a hybrid ranking each channel brought, both channels ranking all documents by themselves."""
    documents, asked = _documents(spark, sf_dir), _questions(spark, sf_dir)
    fused = retrieval.reciprocal_rank_fusion(retrieval.title_top_k(documents, asked, 5), retrieval.bm25(documents, asked, 10))
    channels = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("bm25_rank").isNotNull(), "bm25")))
    return fused.select("query_id", F.explode(channels).alias("channel")).groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("results"))


_UPSERT = """inc as (select *, upper(title) as t2, 'discovered' as s2, updated_at || '~' as u2, case when hash_key % 3 = 1 then doc_id || '+' else doc_id end as id2 from (select *, ('0x' || substr(sha256(doc_id), 1, 7))::bigint as hash_key from catalog_documents) where hash_key % 3 > 0)"""


@register(f"""with {_UPSERT} select d.doc_id, coalesce(i.t2, d.title) as title, d.status, coalesce(i.u2, d.updated_at) as updated_at, d.processing_profile_hash from catalog_documents d left join inc i on i.id2 = d.doc_id
union all select id2, t2, s2, u2, null from inc where hash_key % 3 = 1""")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the catalog come in again as a later parse, half of them under new ids: kept columns stay, new rows come whole."""
    rows = read_table(spark, sf_dir, "catalog_documents").withColumn("is_latest", F.col("is_latest").cast("int"))
    number = F.conv(F.substring(F.sha2("doc_id", 256), 1, 7), 16, 10).cast("bigint")
    again = rows.withColumn("__n", number).filter("__n % 3 > 0").withColumn("title", F.upper("title")).withColumn("status", F.lit("discovered")).withColumn("updated_at", F.concat(F.col("updated_at"), F.lit("~")))
    incoming = again.withColumn("doc_id", F.when(F.col("__n") % 3 == 1, F.concat("doc_id", F.lit("+"))).otherwise(F.col("doc_id"))).withColumn("processing_profile_hash", F.lit(None).cast("string")).drop("__n")
    return catalog.upsert(rows, incoming).select("doc_id", "title", "status", "updated_at", "processing_profile_hash")


@register("""select c.doc_id, count(*) as chunks, min(d.space_id) as space_id from chunks c join catalog_documents d using (doc_id) group by 1""")
def moved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, documents = read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "catalog_documents").select("doc_id", "space_id")
    return catalog.move_space(chunks.join(documents.select("doc_id"), "doc_id", "left_semi"), documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("space_id").alias("space_id"))


@register()
def catalog_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fingerprint(read_table(spark, sf_dir, "catalog_documents"), "doc_id")


@register("""select source, count(*) as documents, sum(size_bytes)::bigint as bytes, count(case when parse_status = 'ready' then 1 end) as ready from catalog_documents group by 1""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "catalog_documents")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size_bytes").alias("bytes"), F.count(F.when(F.col("parse_status") == "ready", 1)).alias("ready"))


@register()
def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rejected = catalog.normalize_documents(read_table(spark, sf_dir, "portfolio_docs"), "public")
    columns = ("doc_id", "title", "content_hash", "language", "visibility")
    return accepted.select(*columns, F.lit(True).alias("accepted")).unionByName(rejected.select(*columns, F.lit(False).alias("accepted")))


@register("""with p as (select doc_id, body, 0 as source_order from portfolio_docs union all
 select d.doc_id, case when summary <> '' then summary else body end, 1 from catalog_documents d join knowledge_spaces s using (space_id) where d.status = 'active' and s.status = 'active')
select doc_id, source_order from (select *, row_number() over (partition by sha256(body) order by source_order, doc_id) as n from p where length(body) > 0) where n = 1""")
def knowledge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public and active private documents, equal bodies once, public ones first."""
    public = read_table(spark, sf_dir, "portfolio_docs").select("doc_id", "title", "body")
    private = catalog.active_documents(read_table(spark, sf_dir, "catalog_documents"), read_table(spark, sf_dir, "knowledge_spaces")).select("doc_id", "title", "body")
    rows = catalog.knowledge_union(public, private).filter(F.length("body") > 0).withColumn("h", keys.content_hash(F.col("body")))
    return catalog.keep_first(rows.select("doc_id", "h", "source_order"), "h", "source_order", "doc_id").select("doc_id", "source_order")


# --- chats and events ------------------------------------------------------------------------------------------------


@register("""with once as (select any_value(session_id) as session_id, message_id, min(sent_at) as sent_at from chat_history group by message_id)
select session_id, message_id, from_end from (select *, row_number() over (partition by session_id order by sent_at desc, message_id desc)::integer as from_end from once) where from_end <= 12""")
def history_last12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_turns(read_table(spark, sf_dir, "chat_history").select("message_id", "session_id", "sent_at")).select("session_id", "message_id", "from_end")


@register("""select user_id, time_bucket(interval '1 day', ts) as bucket_start, count(*) as requests, count(*) <= 2 as allowed from events group by all""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate.rate_buckets(read_table(spark, sf_dir, "events"), "user_id", "ts", "1 day", 2)


@register("""select user_id, event_id, sha256(user_id::varchar || ':' || (epoch_ms(ts) // 60000)::varchar) as bucket_key from events""")
def rate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("user_id", "event_id", keys.rate_key(F.col("user_id"), F.col("ts").cast("timestamp")).alias("bucket_key"))


# the other modules register their queries when they are imported
from strandlake.plans import documents, search, snapshots  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


