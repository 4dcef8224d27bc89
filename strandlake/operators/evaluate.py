"""Quality of rankings: hit, recall, reciprocal rank, discounted gain, refusals and privacy, for batches of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_metrics(rankings: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Metrics of every case. ``rankings``: query_id, doc_id, place (from 1); ``relevant``: query_id, doc_id, relevance.

    A case without relevant documents has recall 1 and gain 1; a document ranked twice gains twice but is recalled
    once; the gain of a place is relevance / log2(place + 1).
    """
    ideal = relevant.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("relevance"), asc=False), 1, k).alias("best"), F.countDistinct("doc_id").alias("expected"))
    ideal_gain = F.aggregate(F.zip_with("best", F.sequence(F.lit(1), F.size("best")), lambda r, p: r / F.log2(p + F.lit(1.0))), F.lit(0.0), lambda s, g: s + g)
    cut = rankings.filter(F.col("place") <= k).join(relevant, ["query_id", "doc_id"], "left")
    found = cut.groupBy("query_id").agg(
        F.countDistinct(F.when(F.col("relevance") > 0, F.col("doc_id"))).alias("found"), F.min(F.when(F.col("relevance") > 0, F.col("place"))).alias("first"),
        F.sum(F.coalesce("relevance", F.lit(0)) / F.log2(F.col("place") + F.lit(1.0))).alias("gain"),
    )
    cases = rankings.select("query_id").unionByName(relevant.select("query_id")).distinct()
    made = cases.join(ideal.withColumn("ideal", ideal_gain), "query_id", "left").join(found, "query_id", "left").fillna({"found": 0, "gain": 0.0, "expected": 0, "ideal": 0.0})
    return made.select(
        "query_id", (F.col("found") > 0).cast("int").alias("hit"),
        F.round(F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(1.0), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(F.col("ideal") > 0, F.col("gain") / F.col("ideal")).otherwise(1.0), 6).alias("ndcg"),
    )


def benchmark(cases: DataFrame, rankings: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row for all cases (query_id, answerable): means over the answerable ones, and how many others found nothing.

    Without answerable cases the means are 0; without others the accuracy of not answering is 1.
    """
    measured = case_metrics(rankings, relevant, k)
    ranked = rankings.select("query_id").distinct().withColumn("__any", F.lit(True))
    made = cases.select("query_id", "answerable").join(measured, "query_id", "left").join(ranked, "query_id", "left")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("answerable"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))), F.lit(0.0)), 6).alias(c)
    silent = F.when(~F.col("answerable"), F.when(F.col("__any").isNull(), 1.0).otherwise(0.0))
    return made.agg(
        F.count(F.lit(1)).alias("cases"), F.sum(F.col("answerable").cast("int")).cast("bigint").alias("answerable"), *(mean(c) for c in ("hit", "recall", "reciprocal_rank", "ndcg")),
        F.round(F.coalesce(F.avg(silent), F.lit(1.0)), 6).alias("no_answer_accuracy"),
    )


def section_metrics(results: DataFrame, questions: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Hit rates and mean reciprocal rank of ranked résumé chunks, one row.

    ``questions``: query_id, expected_section_type and, where one is expected, expected_entity, a text that the entity's
    title or body contains, case ignored; ``results``: query_id, place, section_type, entity_title, body.
    """
    names = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.coalesce("expected_entity", F.lit(""))))
    right = results.join(questions, "query_id").filter((F.col("section_type") == F.col("expected_section_type")) & (names("entity_title") | names("body")))
    first = questions.select("query_id").join(right.groupBy("query_id").agg(F.min("place").alias("first")), "query_id", "left")
    hits = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias(f"hit_at_{k}") for k in cutoffs]
    return first.agg(F.count(F.lit(1)).alias("questions"), *hits, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def privacy_violations(rankings: DataFrame, documents: DataFrame) -> DataFrame:
    """Number of ranked documents that aren't public, of every case that has some."""
    closed = documents.filter(F.coalesce("visibility", F.lit("public")) != "public").select("doc_id")
    return rankings.join(closed, "doc_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("violations"))
