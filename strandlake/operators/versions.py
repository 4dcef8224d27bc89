"""Version groups: documents that are states of one another, by title and shared features of their bodies.

Two documents of one space are linked if their bodies are equal, or if their title keys are equal or alike and their
bodies share enough features; an empty title key is like no other. ``catalog.version_inputs`` gives the documents that
groups are made of and their titles.

Pairs are found by an exact prefix filter: with the features of each body in one global order (rarest first), two
sets of a Jaccard similarity of t share a feature among the first n - ceil(t n) + 1 of each. Equal bodies stand as
one representative, so that copies make no pairs among themselves. Components come from repeated grouped minima.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.common import materialize, spread_join, spread_pairs
from strandlake.functions import keys
from strandlake.functions.text import version_title_key


def body_features(df: DataFrame, body: str = "body", keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the kept columns and the distinct hashes of words of 2 to 40 characters and of 12-character stretches every 6 characters."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(body), F.lit(""))), r"\s+", " "))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w).between(2, 40))
    tight = F.regexp_replace(low, r"\s+", "")
    # stretches from every 6th character: those from every 12th, and from every 12th after the first 6
    stretches = F.concat(*(F.regexp_extract_all(t, F.lit(r"(?s).{12}"), F.lit(0)) for t in (tight, F.substring(tight, 7, 1 << 30))))
    return df.select("doc_id", *keep, F.array_distinct(F.transform(F.concat(words, stretches), lambda f: F.xxhash64(f))).alias("features")).filter(F.size("features") > 0)


#: Titles are alike from this ratio on, bodies from this similarity on.
LEAST_RATIO, LEAST_SIMILARITY = 0.85, 0.78


def similar_pairs(sets: DataFrame, threshold: float = LEAST_SIMILARITY) -> DataFrame:
    """Pairs (a, b, similarity) of sets (doc_id, features) with a Jaccard similarity of at least ``threshold``.

    With ``shortest`` and ``longest``, the bounds of a set's title lengths, only pairs whose titles can be alike are made.
    A feature of many sets is split, so that no task holds all pairs of a common one.
    """
    titled = "longest" in sets.columns
    extra = ("shortest", "longest") if titled else ()
    exploded = sets.select("doc_id", F.size("features").alias("n"), *extra, F.explode("features").alias("f"))
    frequency = exploded.groupBy("f").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # features of one set only can't be shared; the rest in order of rarity
    shared = exploded.join(frequency, "f")
    ordered = materialize(shared.groupBy("doc_id", "n", *extra).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "f"))), lambda s: s["f"]).alias("common")))
    kept = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    prefix = ordered.select("doc_id", "n", *extra, F.explode(F.slice("common", 1, F.greatest(F.lit(1), kept))).alias("f"))
    likely = f"a.doc_id < b.doc_id and a.n * {threshold} <= b.n and b.n * {threshold} <= a.n"
    if titled:
        low, high = "greatest(a.shortest, b.shortest)", "least(a.longest, b.longest)"
        likely += f" and {high} > 0 and ({high} >= {low} or 2 * {high} >= {LEAST_RATIO} * ({high} + {low}))"
    candidates = spread_pairs(prefix, "f", "doc_id", likely).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    left = ordered.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("common").alias("f_a"))
    right = ordered.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("common").alias("f_b"))
    checked = candidates.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("f_a", "f_b")))
    similarity = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return checked.select("a", "b", F.round(similarity, 6).alias("similarity")).filter(F.col("similarity") >= threshold)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """doc_id and the smallest id of its component, for edges (a, b): large-star and small-star by turns.

    Each round links every node to the least of its neighbourhood; both steps are grouped minima and joins, rounds
    are cut by checkpoints, and the loop ends when no link changes; links that haven't settled are an error.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both, least, "u", "n", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.filter("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(down, least, "u", "n", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = materialize(small.filter("u <> v").distinct())
        state = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(30,0)")), F.lit(0)).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "doc_id")
    return roots.unionByName(links.select(F.col("v").alias("doc_id"), F.col("v").alias("root")).distinct().join(roots.select("doc_id"), "doc_id", "left_anti"))


def alike(a: str, b: str, least: float = LEAST_RATIO) -> bool:
    """Whether two title keys are equal or reach this ratio, in either order (the ratio depends on it)."""
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    return a == b or SequenceMatcher(None, a, b).ratio() >= least or SequenceMatcher(None, b, a).ratio() >= least


def alike_titles(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """The pairs (a, b) of which some title keys (doc_id, titles) are alike; an equal body may have several."""

    @F.pandas_udf("boolean")
    def any_alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([not set(a).isdisjoint(b) or any(alike(x, y) for x in a for y in b) for a, b in zip(left, right, strict=True)], dtype=bool)

    left = titles.select(F.col("doc_id").alias("a"), F.col("titles").alias("titles_a"))
    right = titles.select(F.col("doc_id").alias("b"), F.col("titles").alias("titles_b"))
    return pairs.join(left, "a").join(right, "b").filter(any_alike("titles_a", "titles_b")).select(*pairs.columns)


def version_members(df: DataFrame, threshold: float = LEAST_SIMILARITY) -> DataFrame:
    """doc_id, its group's id, its component's smallest id and size, for documents linked to another (equal bodies included).

    Without a column ``title``, bodies alone decide; without ``space_id``, all documents are of one space. The newest
    member of each group is found by ``catalog.latest_versions``.
    """
    space = F.coalesce("space_id", F.lit("")) if "space_id" in df.columns else F.lit("")
    titled = "title" in df.columns
    title = version_title_key(F.coalesce("title", F.lit(""))) if titled else F.lit("")
    body = F.coalesce("body", F.lit(""))
    known = materialize(df.filter(F.length(F.trim(body)) > 0).select("doc_id", F.sha2(F.concat_ws("\u0000", space, body), 256).alias("text"), title.alias("title_key")))
    copies = known.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min(F.length("title_key")).alias("shortest"), F.max(F.length("title_key")).alias("longest"))
    bounds = copies.select(F.col("first").alias("doc_id"), *(("shortest", "longest") if titled else ()))
    features = body_features(df, keep=(space.alias("space"),)).withColumn("features", F.transform("features", lambda f: F.xxhash64("space", f))).drop("space")
    pairs = similar_pairs(features.join(bounds, "doc_id"), threshold)
    if titled:
        titles = known.filter("title_key <> ''").groupBy("text").agg(F.collect_set("title_key").alias("titles"))
        pairs = alike_titles(pairs, titles.join(copies, "text").select(F.col("first").alias("doc_id"), "titles"))
    linked = components(pairs.select("a", "b"))
    whole = spread_join(known.select("doc_id", "text"), copies.select("text", "first", "copies"), "text", "copies", "doc_id").select("doc_id", "first", "copies")
    rooted = whole.join(linked.select(F.col("doc_id").alias("first"), "root"), "first", "left")
    rooted = rooted.filter("root is not null or copies > 1").select("doc_id", F.coalesce("root", "first").alias("root"))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("members"), keys.version_group(F.collect_list(F.col("doc_id").cast("string"))).alias("version_group_id"))
    return spread_join(rooted, sizes, "root", "members", "doc_id").select("doc_id", "version_group_id", "root", "members")
