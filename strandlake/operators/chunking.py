"""Chunk operators: fixed windows, parents and children, records for the index, previews, chunk metrics.

Null and blank bodies give no chunks; texts of any length are split whole, row by row, so that no document ever
meets another in a task's memory. Ids, prefixes and counts are columns; Python only cuts texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from strandlake.functions import keys, preview, profiles
from strandlake.functions.resume import bodies_of, key_of, sections_in, units_of
from strandlake.functions.split import CHILD_LITERALS, SPLITTERS, split_recursive
from strandlake.functions.text import clean_text, count_tokens

#: A piece of a document and its children; ``group_key`` is null where the piece is a semantic group of its own.
PIECES = "array<struct<body string, section_type string, section_path string, entity_title string, group_key string, priority string, children array<string>>>"


def fixed_windows(df: DataFrame, body: str = "body", size: int = 800, step: int = 720) -> DataFrame:
    """Windows of ``size`` characters every ``step``, the last one reaching the end of the text."""
    length = F.length(body)
    last = F.when(length <= size, 0).otherwise(F.ceil((length - size) / step)).cast("int")
    exploded = df.filter(length > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    return exploded.withColumn("chunk_body", F.substring(F.col(body), F.col("chunk_index") * step + 1, F.lit(size)))


def split_bodies(df: DataFrame, body: str = "body", mode: str = "recursive", size: int = 400, overlap: int = 40) -> DataFrame:
    """``df`` with one row for each piece (chunk_index, chunk_body)."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: SPLITTERS[mode](t, size, overlap) if t else [])

    return df.select("*", F.posexplode(pieces(F.col(body))).alias("chunk_index", "chunk_body"))


def _pieces_of(text: str | None, mode: str, most: int, overlap: int, parent_mode: str, parent_most: int, child_most: int) -> list[dict]:
    """The parents of one text and the bodies of their children, in order."""
    if not text:
        return []
    row = lambda body, children, kind="document", path="", entity="", group=None, priority="primary": {"body": body, "section_type": kind, "section_path": path, "entity_title": entity, "group_key": group, "priority": priority, "children": children}
    children = lambda body: split_recursive(body, child_most, overlap, literals=CHILD_LITERALS)
    if mode == "resume_semantic":
        return [row(body, children(body), u.section, f"{u.label} > {u.title}", u.title, key_of(u.group), u.priority) for u in units_of(text) for body in bodies_of(u, most)]
    if mode == "parent_child":
        bodies = SPLITTERS["paragraph" if parent_mode == "paragraph" else "recursive"](text, parent_most, 0)
    else:
        bodies = split_recursive(text, most, overlap)
    heading = lambda body: m.group(1).strip() if (m := re.match(r"#{1,6}\s+(.+)", body)) else ""
    return [row(b, [b] if mode == "general" else children(b), path=heading(b), entity=heading(b)) for b in bodies]


def pieces_udf() -> Callable[[Column, Column], Column]:
    """A column function (text, profile) -> PIECES."""

    @F.pandas_udf(PIECES)
    def pieces(texts: pd.Series, profile: pd.DataFrame) -> pd.Series:
        settings = profile[["chunk_mode", "max_tokens", "overlap_tokens", "parent_mode", "parent_max_tokens", "child_max_tokens"]].itertuples(index=False)
        return pd.Series([_pieces_of(t, *s) for t, s in zip(texts, settings, strict=True)], dtype=object)

    return pieces


def context_prefix(title: Column, project: Column, section: Column, source: Column, updated: Column, entity: Column | None = None) -> Column:
    """The bracketed line of a chunk's origin; empty parts are left out, and an entity that its section path names."""
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    part = lambda label, c, unless=F.lit(False): F.when(filled(c) & ~unless, F.concat(F.lit(f"{label}: "), c))
    named = part("Entity", entity, F.contains(F.coalesce(section, F.lit("")), entity)) if entity is not None else F.lit(None).cast("string")
    parts = (part("Document", title), part("Project", project), part("Section", section), named, part("Source", source), part("Updated", updated))
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))


def chunk_tree(df: DataFrame, profile: Column | None = None) -> DataFrame:
    """Parents and children of documents (doc_id, title, body; project, source, updated where known) cut by a profile.

    The profile is a column (see functions.profiles) or the general one. Bodies are cleaned first. A parent has no
    child_index and no parent_chunk_id; children carry their parent's body and semantic group, and a child of the
    general profile equals its parent. Every document is cut once.
    """
    profile = profiles.GENERAL.column() if profile is None else profile
    column = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    base = df.select(
        "doc_id", F.coalesce(F.when(F.length(F.trim("title")) > 0, F.col("title")), F.lit("Untitled document")).alias("title"), clean_text(F.col("body")).alias("body"), profile.alias("profile"),
        *(column(c).alias(c) for c in ("project", "source", "updated")),
    )
    cut = base.select("*", F.posexplode(pieces_udf()("body", "profile")).alias("parent_index", "u")).drop("body").select("*", "u.*").drop("u")
    prefix = lambda title, entity: context_prefix(title, F.col("project"), F.col("section_path"), F.col("source"), F.col("updated"), entity)
    own = keys.digest("group_", 20, F.col("doc_id"), F.col("section_type"), F.col("group_key"))
    group = F.when(F.col("group_key").isNotNull(), own).otherwise(keys.chunk_id(F.col("doc_id"), F.col("parent_index"), F.col("body")))
    entity = F.coalesce(F.when(F.col("entity_title") != "", F.col("entity_title")), F.col("title"))
    tree = (
        cut.withColumn("parent_chunk_id", keys.parent_id(F.col("doc_id"), F.col("parent_index"), F.col("body")))
        .withColumn("semantic_group_id", group)
        .withColumn("parent_text", F.concat(prefix(F.col("title"), F.col("entity_title")), F.lit("\n"), F.col("body")))
        .withColumn("entity_title", entity)
    )
    # each parent's own text stands before those of its children
    rows = tree.select("*", F.posexplode(F.concat(F.array("body"), "children")).alias("at", "raw_body")).withColumn("child_index", F.when(F.col("at") > 0, F.col("at") - 1))
    young, general = F.col("at") > 0, F.col("profile.chunk_mode") == "general"
    child = F.when(general, keys.digest("child_", 20, F.col("parent_chunk_id"), F.col("raw_body"))).otherwise(keys.child_id(F.col("parent_chunk_id"), F.col("child_index"), F.col("raw_body")))
    text = F.when(~young | general, F.col("parent_text")).otherwise(F.concat(prefix(F.col("entity_title"), F.col("entity_title")), F.lit("\n"), F.col("raw_body")))
    return rows.select(
        "doc_id", "parent_index", "child_index", F.when(young, child).otherwise(F.col("parent_chunk_id")).alias("chunk_id"), F.when(young, F.col("parent_chunk_id")).alias("parent_chunk_id"), "semantic_group_id",
        "section_type", "section_path", "entity_title", F.col("priority").alias("retrieval_priority"), "raw_body", F.col("body").alias("parent_body"), text.alias("retrieval_text"),
        count_tokens(F.col("raw_body")).alias("token_count"), F.length("raw_body").alias("character_count"),
    )


def hierarchy(df: DataFrame, profile: profiles.Profile = profiles.PARENT_CHILD) -> DataFrame:
    """Children under one profile, with content-addressed ids and their parents' bodies."""
    titled = df if "title" in df.columns else df.withColumn("title", F.lit(""))
    return chunk_tree(titled.select("doc_id", "title", "body"), profile.column()).filter("child_index is not null")


def resolved_profile() -> Column:
    """Of catalog rows: the stored profile, else that of the stored chunk settings, else the recommended one."""
    legacy = profiles.from_legacy(F.col("title"), F.col("file_type"), F.col("chunk_strategy"), F.col("chunk_size"), F.col("chunk_overlap"), F.col("chunk_unit"))
    return F.coalesce(profiles.stored(F.col("processing_profile_json")), legacy, profiles.recommended(F.col("file_type"), F.col("title"), F.col("body"), F.col("file_name"), F.col("source")))


def chunk_records(documents: DataFrame, order: Column, profile: Column | None = None) -> DataFrame:
    """The index rows of catalog documents: of equal bodies the first by ``order`` is chunked, by its own profile.

    Only hashes and ids meet in the search for the first ones; bodies stay where they are unless they are joined.
    """
    cleaned = F.sha2(clean_text(F.col("body")), 256)
    profile = resolved_profile() if profile is None else profile
    rows = documents.withColumn("content_hash", cleaned).withColumn("profile", profile).filter(F.length(F.trim(F.coalesce("body", F.lit("")))) > 0)
    firsts = rows.groupBy("content_hash").agg(F.min_by("doc_id", F.struct(order.alias("o"), F.col("doc_id").alias("i"))).alias("doc_id"))
    chosen = rows.join(firsts.select("doc_id"), "doc_id", "left_semi")
    source = F.coalesce(*(F.when(F.length(F.col(c)) > 0, F.col(c)) for c in ("file_name", "relative_path", "source_path")))
    tree = chunk_tree(chosen.select("doc_id", "title", "body", "project", source.alias("source"), F.col("modified_at").alias("updated"), "profile"), F.col("profile"))
    about = chosen.select("doc_id", "content_hash", "title", "space_id", F.coalesce("visibility", F.lit("private")).alias("visibility"), profiles.canonical_digest(F.col("profile")).alias("processing_profile_hash"))
    return tree.filter("child_index is not null").join(about, "doc_id").withColumn("chunk_unit", F.lit("tokens"))


def contract(tree: DataFrame) -> DataFrame:
    """Parents (child_index -1) and children of each document numbered as in a chunk contract: groups by first appearance, parents first."""
    every = tree.withColumn("child_index", F.coalesce("child_index", F.lit(-1)))
    order = F.struct((F.col("child_index") >= 0).alias("late"), "parent_index", "child_index")
    first = F.min(order).over(W.partitionBy("doc_id", "semantic_group_id"))
    return every.withColumn("__first", first).withColumn("semantic_group_index", F.dense_rank().over(W.partitionBy("doc_id").orderBy("__first")) - 1).drop("__first", "semantic_group_id")


def resume_units(df: DataFrame, size: int = profiles.RESUME.max_tokens) -> DataFrame:
    """Résumé segments: section, entity, priority and pieces of up to ``size`` tokens, each with its entity's title.

    Pieces of an entity share a semantic group; all summaries of a section are one group.
    """

    @F.pandas_udf("array<struct<section_type string, label string, entity_title string, group_key string, retrieval_priority string, raw_body string>>")
    def segments(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"section_type": u.section, "label": u.label, "entity_title": u.title, "group_key": key_of(u.group), "retrieval_priority": u.priority, "raw_body": b} for u in units_of(t or "") for b in bodies_of(u, size)])

    made = df.select("doc_id", F.posexplode(segments("body")).alias("chunk_index", "s")).select("doc_id", "chunk_index", "s.*")
    return made.withColumn("semantic_group_id", keys.digest("group_", 20, F.col("doc_id"), F.col("section_type"), F.col("group_key"))).drop("group_key")


def packed_chunks(df: DataFrame, size: int = 180, overlap: int = 20, body: str = "body") -> DataFrame:
    """Paragraphs packed greedily up to ``size`` tokens, longer ones cut at sentences: the packing of published texts."""

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: preview.pack_with_overlap(preview.paragraphs_of(t), size, overlap) if t else [])

    return df.select("*", F.posexplode(packed(F.col(body))).alias("chunk_index", "chunk_body"))


#: What marks a résumé on the published side, where the profile is one of two.
PUBLIC_RESUME = r"(?iu)简历|履历|curriculum\s+vitae|\bresume\b|\bcv\b"


def public_profile(file_name: Column, title: Column, body: Column) -> Column:
    """The mode of a published document: resume_semantic by a marker in its name, title or first 500 characters."""
    text = F.concat_ws("\n", *(F.when(F.length(c) > 0, c) for c in (file_name, title, F.substring(body, 1, 500))))
    return F.when(text.rlike(PUBLIC_RESUME), "resume_semantic").otherwise("parent_child")


def revised_profile(current: Column, file_name: Column, title: Column, body: Column) -> Column:
    """The mode after a revision: a résumé becomes one, otherwise the mode stays."""
    return F.when(public_profile(file_name, title, body) == "resume_semantic", "resume_semantic").otherwise(current)


def preview_chunks(df: DataFrame, mode: Column, parent_tokens: int = 700, child_tokens: int = 180, overlap: int = 20, delimiter: str = "\n\n") -> DataFrame:
    """Children of published texts (doc_id, title, body) with their parents, as shown before publication."""

    @F.pandas_udf("array<struct<body string, section_type string, section_path string, entity_title string, group_key string, children array<string>>>")
    def cut(texts: pd.Series, titles: pd.Series, modes: pd.Series) -> pd.Series:
        row = lambda s, parent, children: {"body": parent, "section_type": s.kind, "section_path": s.path, "entity_title": s.entity, "group_key": preview.entity_key(s.entity), "children": children}
        return pd.Series([[row(*p) for p in preview.preview(t, n, m, parent_tokens, child_tokens, overlap, delimiter)] if t else [] for t, n, m in zip(texts, titles, modes, strict=True)], dtype=object)

    titled = df.select("doc_id", "body", F.coalesce("title", F.lit("")).alias("title"), mode.alias("mode"))
    made = titled.select("doc_id", "title", F.posexplode(cut("body", "title", "mode")).alias("parent_index", "u")).select("doc_id", "title", "parent_index", "u.*")
    made = made.withColumn("parent_chunk_id", keys.digest("parent_", 16, F.col("title"), F.col("section_path"), F.col("body"), between=":"))
    made = made.withColumn("semantic_group_id", keys.digest("group_", 20, F.col("title"), F.col("section_type"), F.col("group_key"), between=":"))
    made = made.select("*", F.posexplode("children").alias("child_index", "raw_body"))
    heading = F.concat(F.lit("[Document: "), F.col("title"), F.lit(" | Section: "), F.col("section_path"), F.lit(" | Entity: "), F.col("entity_title"), F.lit("]\n"))
    return made.select(
        "doc_id", "parent_index", "child_index", keys.digest("chunk_", 16, F.col("parent_chunk_id"), F.col("child_index"), F.col("raw_body"), between=":").alias("chunk_id"), "parent_chunk_id", "semantic_group_id",
        "section_type", "section_path", "entity_title", "raw_body", F.col("body").alias("parent_body"), F.concat(heading, F.col("raw_body")).alias("retrieval_text"),
        F.regexp_count("raw_body", F.lit(r"[A-Za-z0-9][A-Za-z0-9.+#:_/-]*|[\x{3400}-\x{9FFF}]|\S")).cast("bigint").alias("token_count"), F.length("raw_body").alias("character_count"),
    )


@F.pandas_udf(BooleanType())
def _crosses(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(sections_in(t or "")) > 1).astype(bool)


def chunk_metrics(chunks: DataFrame, body: str = "chunk_body") -> DataFrame:
    """Counts, lengths and warnings for the chunks of each document (halves round to even).

    Chunks of sections (a column section_type other than document) may be short without a warning.
    """
    length, tokens = F.length(body), count_tokens(F.col(body))
    semantic = (F.coalesce("section_type", F.lit("document")) != "document") if "section_type" in chunks.columns else F.lit(False)
    made = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.bround(F.avg(length)).cast("bigint").alias("average_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"),
        F.sum(tokens).alias("tokens"), F.bround(F.avg(tokens)).cast("bigint").alias("average_tokens"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"),
        F.sum((length < 100).cast("int")).cast("bigint").alias("short_chunks"), F.max(semantic).alias("semantic"), F.sum(_crosses(F.col(body)).cast("int")).cast("bigint").alias("cross_topic"),
    )
    short = F.col("short_chunks") >= 0.25 * F.col("chunks")
    made = made.withColumn("short_ratio", F.bround(F.col("short_chunks") / F.col("chunks"), 3))
    return made.withColumn("many_short", short & ~F.col("semantic")).withColumn("too_long", F.col("max_length") > 1600)
