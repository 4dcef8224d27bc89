"""Publication as snapshots: rows of published documents and chunks, the public corpus, its seed and its index.

States of drafts and who may change them are left out. Tables are next snapshots, written by the caller; nothing here is
transactional.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import keys
from strandlake.functions.embed import Embedder, HashingEmbedder
from strandlake.functions.text import is_mojibake
from strandlake.operators import catalog
from strandlake.operators.retrieval import matched_terms


def publication(drafts: DataFrame, chunks: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) as published. ``drafts``: draft_id, owner_id, title, summary, category, language, body, version,
    space_id, url; ``chunks``: preview chunks with draft_id. A missing category or space is portfolio, a version at least 1."""
    version = F.greatest(F.lit(1), F.coalesce("version", F.lit(1)))
    text = lambda c, default: F.coalesce(F.when(F.length(F.trim(c)) > 0, F.trim(c)), F.lit(default)).alias(c)
    made = drafts.select(
        "draft_id", keys.owner_document_id(F.col("owner_id"), F.col("draft_id")).alias("doc_id"), "owner_id", F.lit("owner_upload").alias("source_origin"), text("space_id", "portfolio"), text("title", ""),
        text("summary", ""), text("category", "portfolio"), "language", F.col("body").alias("cleaned_body"), keys.content_hash(F.col("body")).alias("content_hash"), F.lit("published").alias("status"),
        F.lit("public").alias("visibility"), version.cast("int").alias("publication_version"), F.when(F.col("url").rlike(r"(?i)^\s*https?://[^/?#\s]+"), F.col("url")).alias("source_url"), F.lit(now).alias("updated_at"),
    )
    about = made.select("draft_id", "doc_id", "owner_id", "space_id", "title", "summary", "category", "language", "publication_version", "content_hash", F.col("source_url").alias("url"), "updated_at")
    rows = chunks.drop("doc_id", "title").join(about, "draft_id")
    chunk = keys.owner_chunk_id(F.col("doc_id"), F.col("publication_version"), F.col("chunk_id"), F.col("retrieval_text"))
    columns = ("parent_chunk_id", "section_type", "section_path", "entity_title", "semantic_group_id", "token_count", "parent_body", "retrieval_text")
    published = rows.select(
        "doc_id", chunk.alias("chunk_id"), *columns, F.col("parent_body").alias("raw_body"), F.col("raw_body").alias("child_body"), "owner_id", "space_id", "title", "summary", "category", "language",
        "publication_version", "content_hash", "url", F.lit("public").alias("visibility"), F.lit("active").alias("validity_status"), "updated_at",
    )
    return made.drop("draft_id"), published


def commit(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next (documents, chunks): of each document the newest version, and the chunks of that version alone.

    A document that is already there in the same version or a later one stays as it is.
    """
    known = documents.select("doc_id", F.col("publication_version").alias("__have")).groupBy("doc_id").agg(F.max("__have").alias("__have"))
    newer = new_documents.join(known, "doc_id", "left").filter("__have is null or publication_version > __have").drop("__have")
    kept = documents.join(newer.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(newer, allowMissingColumns=True), catalog.replace_chunks(chunks, new_chunks.join(newer.select("doc_id"), "doc_id", "left_semi"))


def add_public(documents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rows that were there already): a body that is known under any id isn't added again.

    Of several new rows with one body the one with the smallest id is added.
    """
    accepted, _ = catalog.normalize_documents(new, "public")
    accepted = accepted.withColumn("visibility", F.lit("public"))
    hashes = documents.select("content_hash").distinct()
    firsts = catalog.keep_first(accepted, "content_hash", "doc_id")
    added = firsts.join(hashes, "content_hash", "left_anti")
    return documents.unionByName(added.select(*(c for c in added.columns if c in documents.columns)), allowMissingColumns=True), accepted.join(hashes, "content_hash", "left_semi")


def save_private(documents: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Private documents by body: the last of each by ``order`` (a column of both), in the place of the first."""
    accepted, _ = catalog.normalize_documents(new, "private")
    both = documents.unionByName(accepted.withColumn("visibility", F.lit("private")).select(*documents.columns))
    return catalog.overwrite_by_key(both, "content_hash", order)


def remove(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.join(ids.select("doc_id"), "doc_id", "left_anti")


def archive(documents: DataFrame, archived: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(documents without the archived ones, archive with them and their time)."""
    gone = documents.join(ids.select("doc_id"), "doc_id", "left_semi").withColumn("archived_at", F.lit(now))
    return remove(documents, ids), archived.unionByName(gone, allowMissingColumns=True)


def seed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to seed, faults): public rows with trimmed texts, hashes, ids, and a summary where one is missing.

    Faults (doc_id, fault): empty_text, not_public, mojibake, duplicate_hash, duplicate_id. A seed with faults isn't
    valid as a whole; which of several equal rows is at fault isn't said, so all of them are named.
    """
    column = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
    trimmed = lambda name: F.regexp_replace(F.coalesce(column(name), F.lit("")), r"^\s+|\s+$", "")
    filled = lambda c: F.when(F.length(c) > 0, c)
    about = lambda name: F.col("metadata")[name] if "metadata" in raw.columns else F.lit(None).cast("string")
    made = raw.withColumn("title", trimmed("title")).withColumn("body", trimmed("body"))
    made = made.withColumn("content_hash", F.coalesce(filled(column("content_hash")), keys.content_hash(F.col("body"))))
    made = made.withColumn("doc_id", F.coalesce(filled(column("doc_id")), keys.digest("doc_", 20, F.col("title"), F.col("content_hash"))))
    rows = made.select(
        "doc_id", "title", "body", "content_hash", F.coalesce(filled(column("visibility")), about("visibility"), F.lit("public")).alias("visibility"), F.lit("published").alias("status"), F.lit("repo_seed").alias("source_origin"),
        F.coalesce(filled(column("space_id")), about("space_id"), F.lit("portfolio")).alias("space_id"), F.coalesce(filled(trimmed("summary")), F.trim(F.substring("body", 1, 240))).alias("summary"),
        F.coalesce(filled(column("category")), about("category"), F.lit("portfolio")).alias("category"), F.when((column("language") == "zh") | (about("language") == "zh"), "zh").otherwise("en").alias("language"),
        F.coalesce(filled(column("source_url")), filled(column("url"))).alias("source_url"),
    )
    single = {"empty_text": (F.col("title") == "") | (F.col("body") == ""), "not_public": F.col("visibility") != "public", "mojibake": is_mojibake(F.concat_ws("\n", "title", "body"))}
    own = rows.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in single.items())))).alias("fault"))
    several = lambda key, fault: rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), key, "left_semi").select("doc_id", F.lit(fault).alias("fault"))
    return rows, own.unionByName(several("content_hash", "duplicate_hash")).unionByName(several("doc_id", "duplicate_id"))


def sync_seed(documents: DataFrame, seeded: DataFrame, now: str) -> DataFrame:
    """The next snapshot of published documents: seeded rows are written over, those that left the seed go, owners' rows stay."""
    own = documents.filter("source_origin <> 'repo_seed'")
    before = documents.filter("source_origin = 'repo_seed'").groupBy("doc_id").agg(F.min("created_at").alias("created_at"))
    made = seeded.join(before, "doc_id", "left").withColumn("created_at", F.coalesce("created_at", F.lit(now))).withColumn("updated_at", F.lit(now))
    return own.unionByName(made.select(*(c for c in made.columns if c in documents.columns)), allowMissingColumns=True)


def rebuild_index(chunks: DataFrame, folder: str, embedder: Embedder | None = None, spaces: Sequence[str] | None = None) -> None:
    """The whole index anew: chunks with their vectors, and the number and counts of terms of each, by space.

    Every chunk is cut into terms and embedded once; old contents of ``folder`` are replaced.
    """
    rows = chunks if spaces is None else chunks.filter(F.col("space_id").isin(*spaces))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "raw_body")
    rows.withColumn("embedding", (embedder or HashingEmbedder()).column(text)).write.mode("overwrite").partitionBy("space_id").parquet(f"{folder}/chunks")
    terms = matched_terms(rows.select(F.col("chunk_id").alias("doc_id"), "space_id", text.alias("text")), "text", ["space_id"], None)
    terms.withColumnRenamed("doc_id", "chunk_id").write.mode("overwrite").partitionBy("space_id").parquet(f"{folder}/terms")
