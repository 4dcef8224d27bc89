"""Queries of retrieval over chunks, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import read_table, written
from strandlake.functions import text as T
from strandlake.operators import evaluate, retrieval
from strandlake.plans import prompt
from strandlake.plans.base import _SEARCH, CHUNK_SQL, any_marker, chunk_rows, messages, register, section_value

#: SQL of the hashing embedder for lists of terms {t}, and of cosines of lists, 0 for zero vectors.
_EMBED = "list_transform(range(64), lambda d: coalesce(list_sum(list_transform(list_filter(list_transform({t}, lambda t: ('0x' || substr(md5(t), 1, 8))::bigint), lambda n: (n // 2) % 64 = d), lambda n: 1.0 - 2 * (n % 2))), 0.0)::double)"
_COSINE = "round(case when list_sum(list_transform({a}, lambda x: x * x)) * list_sum(list_transform({b}, lambda x: x * x)) = 0 then 0.0 else list_cosine_similarity({a}, {b}) end, 6)"
_STOP = "('" + "', '".join(retrieval.STOP_WORDS) + "')"

_WORDS = f"""{CHUNK_SQL},
ct as (select *, {_SEARCH.replace('{x}', 'txt')} as t from ch),
qt as (select *, {_SEARCH.replace('{x}', 'question')} as t from ask),
cv as (select *, {_EMBED.replace('{t}', 't')} as v from ct),
qv as (select *, {_EMBED.replace('{t}', 't')} as v from qt),
cosines as (select query_id, question, c.*, {_COSINE.replace('{a}', 'q.v').replace('{b}', 'c.v')} as score from qv q join cv c using (space_id)),
near as (select * exclude (t, v), row_number() over (partition by query_id order by score desc, chunk_id) as vector_rank from cosines)"""

_SPARSE = """tf as (select space_id, chunk_id, len(t) as length, unnest(t) as term from ct),
post as (select space_id, term, chunk_id, length, count(*) as tf from tf group by all),
asked as (select query_id, space_id, term, count(*) as times from (select query_id, space_id, unnest(t) as term from qt) group by all),
sizes as (select space_id, count(*) as n, greatest(avg(len(t)), 1.0) as avgdl from ct group by 1),
dfs as (select space_id, term, count(*) as df from post group by all),
scored as (select query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) as bm25_score
  from post join asked using (space_id, term) join dfs using (space_id, term) join sizes using (space_id) group by all),
sparse as (select *, row_number() over (partition by query_id order by bm25_score desc, chunk_id) as bm25_rank from scored where bm25_score > 0)"""

_KEYWORDS = f"least(0.18, 0.06 * len(list_filter(list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9.+#-]{{1,}}'), lambda t: lower(t))), lambda t: contains(lower(txt), t) and t not in {_STOP})))"
_BOOSTED = f"select *, round(score + {_KEYWORDS}, 6) as rank_score from near where vector_rank <= {{pool}}"
_SECTION = section_value("section_type", "question")
_FRESH = f"""select *, round(intent_score + case when {any_marker('question', retrieval.FRESH)} then coalesce((dated - min(dated) over w) / greatest(max(dated) over w - min(dated) over w, 1.0), 0.0) * 0.08 else 0.0 end, 6) as freshness_score
 from (select *, case when strftime(updated_at, '%Y') like '20%' then strftime(updated_at, '%Y%m%d')::double end as dated from {{rows}}) window w as (partition by query_id)"""


def _selected(rows: str, score: str, k: int) -> str:
    """SQL of select_results over every row's own space: one row a group, primary rows first."""
    order = f"case when coalesce(retrieval_priority, 'primary') = 'secondary' then 1 else 0 end, {score} desc, chunk_id"
    return f"""one as (select * from (select *, row_number() over (partition by query_id, coalesce(nullif(semantic_group_id, ''), chunk_id) order by {order}) as g from {rows}) where g = 1),
final as (select *, row_number() over (partition by query_id order by {order})::integer as place from one)
select query_id, chunk_id, place, round({score}, 4) as result_score from final where place <= {k}"""


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", "place", F.round("result_score", 4).alias("result_score"))


_BASELINE = f"{_WORDS}, boosted as ({_BOOSTED.replace('{pool}', '25')}), sectioned as (select *, round(rank_score + {_SECTION}, 6) as intent_score from boosted), fresh as ({_FRESH.replace('{rows}', 'sectioned')})"


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the date that freshness goes by; written once, as every search reads them several times."""
    return written(chunk_rows(spark, sf_dir).withColumn("updated_number", T.date_number(F.date_format("updated_at", "yyyy-MM-dd"))))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(messages(spark, sf_dir))


@register(f"with {_BASELINE}, {_selected('fresh', 'freshness_score', 5)}")
def vector_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(retrieval.baseline_search(_searched(spark, sf_dir), _asked(spark, sf_dir)))


@register(f"with {_WORDS}, {_SPARSE}, rows as (select s.*, c.* exclude (chunk_id), round(bm25_score / max(bm25_score) over (partition by query_id), 6) as score from sparse s join ch c using (chunk_id) where bm25_rank <= 50), {_selected('rows', 'score', 5)}")
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(retrieval.fulltext_search(_searched(spark, sf_dir), _asked(spark, sf_dir)))


_FUSED = f"""{_WORDS}, {_SPARSE}, boosted as ({_BOOSTED.replace('{pool}', '50')}),
parts as (select query_id, chunk_id, 2.0 / (60 + row_number() over (partition by query_id order by rank_score desc, chunk_id)) as p, score, null::double as bm25_score from boosted
  union all select query_id, chunk_id, 0.7 / (60 + bm25_rank), null, bm25_score from sparse where bm25_rank <= 50),
fusion as (select query_id, chunk_id, round(sum(p), 6) as fusion_score, max(score) as score, max(bm25_score) as bm25_score from parts group by all),
fused as (select f.query_id, question, f.fusion_score, coalesce(score, round(bm25_score / max(bm25_score) over (partition by f.query_id), 6)) as score, c.* from fusion f join ch c using (chunk_id) join ask a using (query_id)),
intended as (select *, round(fusion_score + {_SECTION}, 6) as intent_score from fused)"""


@register(f"with {_FUSED}, {_selected('intended', 'intent_score', 5)}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels over all chunks of the asked space, fused by reciprocal ranks."""
    return _result(retrieval.hybrid_search(_searched(spark, sf_dir), _asked(spark, sf_dir)))


_SHARE = f"round(len(list_intersect(list_distinct({_SEARCH.replace('{x}', 'question')}), list_distinct({_SEARCH.replace('{x}', 'txt')}))) / greatest(len(list_distinct({_SEARCH.replace('{x}', 'question')})), 1)::double, 6)"


@register(f"""with {_FUSED}, candidates as (select * exclude (intent_score), row_number() over (partition by query_id order by intent_score desc, chunk_id) as candidate from intended),
ranked as (select *, row_number() over (partition by query_id order by reranker_score desc, chunk_id) as r from (select *, {_SHARE} as reranker_score from candidates where candidate <= 20)),
again as (select *, round(reranker_score + {_SECTION}, 6) as intent_score from ranked where r <= 5), {_selected('again', 'intent_score', 5)}""")
def hybrid_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid results ranked anew by a scorer of pairs, here the share of common terms."""
    return _result(retrieval.hybrid_search(_searched(spark, sf_dir), _asked(spark, sf_dir), scorer=retrieval.shared_terms))


_SPACES3 = ("lab-notes", "course-archive", "portfolio")


@register(f"""with {_WORDS}, firsts as (select *, row_number() over (partition by query_id, space_id order by score desc, chunk_id) as f from (select query_id, c.*, {_COSINE.replace('{a}', 'q.v').replace('{b}', 'c.v')} as score from qv q, cv c where c.space_id in {_SPACES3} and visibility = 'public')),
pool as (select *, coalesce(nullif(semantic_group_id, ''), chunk_id) as grp, case when coalesce(retrieval_priority, 'primary') = 'secondary' then 1 else 0 end as late from firsts where f <= 10 and score >= 0.1),
one as (select * from (select *, row_number() over (partition by query_id, grp order by late, score desc, chunk_id) as g from pool) where g = 1),
best as (select *, case when row_number() over (partition by query_id, space_id order by late, score desc, chunk_id) = 1 then list_position(['lab-notes', 'course-archive', 'portfolio'], space_id) else 4 end as b from one)
select query_id, chunk_id, space_id, place from (select *, row_number() over (partition by query_id order by b, late, score desc, chunk_id)::integer as place from best) where place <= 6""")
def select_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question asked of three spaces: public rows above a threshold, one a group, the best of every space first."""
    asked = _asked(spark, sf_dir).drop("space_id").withColumn("space_id", F.explode(F.array(*map(F.lit, _SPACES3))))
    chunks = _searched(spark, sf_dir).filter("visibility = 'public'")
    pool = retrieval.vector_pool(chunks, asked, 10, retrieval.HashingEmbedder())
    return retrieval.select_results(retrieval.described(pool, chunks, asked), 6, spaces=_SPACES3, threshold=0.1).select("query_id", "chunk_id", "space_id", "place")


_FAST = _selected("fresh", "freshness_score", 10).replace("\nselect query_id, chunk_id, place, round(freshness_score, 4) as result_score from final", ",\nfast as (select query_id, chunk_id, place, score from final") + ")"
_BEST = f"""{_BASELINE.replace('vector_rank <= 25', 'vector_rank <= 50')}, {_FAST},
two as (select query_id, max(case when n = 1 then score end) as top, max(case when n = 2 then score end) as second from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as n from fast) where n <= 2 group by 1),
reasoned as (select query_id, top, second, concat_ws(',', case when {any_marker('question', retrieval.COMPLEX)} then 'complex-query' end, case when coalesce(top < 0.45 or round(top - second, 9) < 0.02, true) then 'low-confidence' end) as reasons from ask left join two using (query_id))"""


@register(f"with {_BEST} select query_id, top, second, reasons, reasons <> '' as rerank from reasoned")
def adaptive_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the baseline's ten best results are clear, and why not."""
    asked = _asked(spark, sf_dir)
    fast = retrieval.baseline_search(_searched(spark, sf_dir), asked, 10)
    return retrieval.adaptive_decision(fast, retrieval.plan_questions(asked))


@register()
def adaptive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.adaptive_search(_searched(spark, sf_dir), _asked(spark, sf_dir))


@register()
def preview_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's title asked of its own chunks."""
    chunks = chunk_rows(spark, sf_dir)
    asked = chunks.filter("length(trim(title)) > 0").groupBy("doc_id").agg(F.min("title").alias("question")).withColumn("query_id", F.col("doc_id"))
    return retrieval.preview_search(chunks, asked, 3).select("query_id", "chunk_id", "place", F.round("result_score", 4).alias("result_score"))


_CANDIDATES = f"""{_WORDS.replace("left join catalog_documents d using (doc_id) where n = 1", "left join catalog_documents d using (doc_id) where n = 1 and c.visibility = 'public'")}, {_SPARSE},
parts as (select query_id, chunk_id, 2.0 / (60 + vector_rank) as p from near where vector_rank <= 50 union all select query_id, chunk_id, 0.7 / (60 + bm25_rank) from sparse where bm25_rank <= 50),
fusion as (select query_id, chunk_id, round(sum(p), 6) as fusion_score from parts group by all),
placed as (select *, row_number() over (partition by query_id order by fusion_score desc, chunk_id)::integer as place from fusion)"""


@register(f"with {_CANDIDATES} select query_id, chunk_id, place, round(fusion_score, 4) as fusion_score from placed where place <= 20")
def public_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published chunks, the channels fused inside the asked space."""
    made = retrieval.public_candidates(_searched(spark, sf_dir), _asked(spark, sf_dir), 20)
    return made.select("query_id", "chunk_id", "place", F.round("fusion_score", 4).alias("fusion_score"))


@register()
def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts from each question's published candidates, one for each parent and group, as many as its intent asks."""
    return _contexts(_searched(spark, sf_dir), _asked(spark, sf_dir))


def _contexts(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    pool = retrieval.described(retrieval.public_candidates(chunks, asked, 50).drop("place"), chunks.drop("raw_body"), asked)
    sized = retrieval.top_k(pool, "fusion_score", 50, "candidate", "chunk_id").filter(F.col("candidate") <= retrieval.candidate_limit(retrieval.answer_intent(F.col("question")), 5))
    return retrieval.select_contexts(sized, 5, "fusion_score")


@register("""select message_id as query_id, case when regexp_matches(q, '(?i)最强|最好|最佳|最突出|最有代表性|最相关|strongest|best|top\\s+(projects?|examples?|experiences?)') then 'ranked'
 when regexp_matches(q, '(?i)全部|所有|有哪些|都有哪些|列出|完整清单|\\b(all|every|list)\\b|\\b(what|which)\\b[^?]*(projects|experiences|skills|items|documents)\\b') then 'exhaustive' else 'fact' end as intent
 from (select message_id, coalesce(min(content), '') as q from chat_history where msg_role = 'user' group by 1)""")
def answer_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "chat_history").filter("msg_role = 'user'").groupBy(F.col("message_id").alias("query_id")).agg(F.min("content").alias("content"))
    return rows.select("query_id", retrieval.answer_intent(F.col("content")).alias("intent"))


@register()
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each question: numbered evidence, what its intent asks, the session's last messages before it."""
    history = read_table(spark, sf_dir, "chat_history")
    asked, chunks = _asked(spark, sf_dir), _searched(spark, sf_dir)
    contexts = _contexts(chunks, asked).join(chunks.select("chunk_id", "title", F.col("raw_body").alias("body")), "chunk_id")
    made = prompt.chat_prompts(asked, contexts, prompt.recent_turns(asked, history))
    return made.select("query_id", F.sha2("prompt", 256).alias("prompt_hash"), "sources", "turns")



@register(f"""with {_WORDS.split('cosines as')[0].rstrip().rstrip(',')},
cases as (select query_id, question, exists (select 1 from ch c where c.space_id = a.space_id and contains(lower(c.txt), lower(a.question))) as answerable, space_id from ask a),
rel as (select a.query_id, c.chunk_id from ask a join ch c on c.space_id = a.space_id and contains(lower(c.txt), lower(a.question))),
cosines as (select query_id, c.chunk_id, {_COSINE.replace('{a}', 'q.v').replace('{b}', 'c.v')} as score from qv q join cv c using (space_id)),
hits as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as place from cosines) where place <= 5),
found as (select h.query_id, count(*) filter (r.chunk_id is not null) as n, min(place) filter (r.chunk_id is not null) as first from hits h left join rel r using (query_id, chunk_id) group by 1)
select count(*) as cases, count(*) filter (answerable) as answerable, round(coalesce(avg(case when answerable then case when coalesce(n, 0) > 0 then 1.0 else 0.0 end end), 0.0), 6) as hit, round(coalesce(avg(case when answerable then coalesce(1.0 / first, 0.0) end), 0.0), 6) as mrr,
round(coalesce(avg(case when not answerable then case when n is null then 1.0 else 0.0 end end), 1.0), 6) as no_answer_accuracy from cases left join found using (query_id)""")
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole benchmark in one row: questions that some chunk of their space contains are answerable, the others should find nothing."""
    chunks, asked = _searched(spark, sf_dir), _asked(spark, sf_dir)
    texts = chunks.select("chunk_id", "space_id", F.concat_ws(" ", "title", "raw_body").alias("text"))
    relevant = written(retrieval.contained(texts, asked).select("query_id", F.col("chunk_id").alias("doc_id"), F.lit(1).alias("relevance")))
    rankings = retrieval.vector_pool(chunks, asked, 5, retrieval.HashingEmbedder()).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("vector_rank").alias("place"))
    cases = asked.join(relevant.select("query_id").distinct().withColumn("answerable", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("answerable", F.lit(False)).alias("answerable"))
    return evaluate.benchmark(cases, rankings, relevant, 5).select("cases", "answerable", "hit", F.col("reciprocal_rank").alias("mrr"), "no_answer_accuracy")
