"""Catalog operators: identities, duplicates, versions, spaces, snapshots.

Tables are snapshots: a change is a new DataFrame, written by the caller. Missing texts equal empty ones where a
key is built of them. Keep-first and keep-last take an explicit order, so that repeated rows give one result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import keys, profiles
from strandlake.functions.text import clean_text, detect_language, file_stem, slugify

#: Columns that a second write of a document leaves as they are, and columns that may be filtered and searched.
KEPT_ON_UPSERT = ("status", "space_id", "created_at", "summary", "is_latest", "version_group_id", "profile_version", "processing_profile_json", "processing_profile_hash")
FILTERABLE = ("status", "source", "file_type", "project", "parse_status", "visibility", "space_id")
SEARCHABLE = ("title", "body", "summary", "source_path", "relative_path")
#: Statuses of parsing that a document keeps whatever else it would be.
UNREADABLE = ("parse_error", "needs_ocr")


def _filled(column: Column | str) -> Column:
    """The column, null where it is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(column) > 0, column)


def _known(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalize_documents(raw: DataFrame, default_visibility: str = "private") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents: cleaned titles and bodies, ids and visibility.

    Empty bodies, and a visibility other than public or private, are rejected. A missing visibility is that of the
    metadata (a map), else the default. Ids that are given stay.
    """
    metadata = F.col("metadata")["visibility"] if "metadata" in raw.columns else F.lit(None).cast("string")
    visibility = F.coalesce(_filled(_known(raw, "visibility")), _filled(metadata), F.lit(default_visibility))
    made = raw.withColumn("title", clean_text(F.coalesce(_filled("title"), F.lit("Untitled document")))).withColumn("body", clean_text(F.coalesce("body", F.lit("")))).withColumn("visibility", visibility)
    made = made.withColumn("content_hash", keys.content_hash(F.col("body"))).withColumn("language", detect_language(F.col("body")))
    made = made.withColumn("doc_id", F.coalesce(_filled(_known(made, "doc_id").cast("string")), keys.document_id(F.col("title"), F.col("body"))))
    valid = (F.length("body") > 0) & F.col("visibility").isin("public", "private")
    return made.filter(valid), made.filter(~valid)


def replace_bodies(documents: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot with new bodies (doc_id, body): ids stay, hashes and languages follow; empty bodies change nothing."""
    fresh = new.select("doc_id", clean_text(F.col("body")).alias("__new")).filter(F.length("__new") > 0)
    made = documents.join(keep_last(fresh, "doc_id", "__new"), "doc_id", "left")
    body = F.coalesce("__new", "body")
    changed = {"body": body, "content_hash": F.when(F.col("__new").isNotNull(), keys.content_hash(body)).otherwise(F.col("content_hash")), "language": F.when(F.col("__new").isNotNull(), detect_language(body)).otherwise(F.col("language"))}
    return made.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns))


def catalog_rows(raw: DataFrame, now: str, active: DataFrame | None = None) -> DataFrame:
    """Catalog rows of scanned files: names, types and projects from paths, chunk settings by type, a status.

    ``raw``: source, relative_path, title, body and, where known, path, project, size_bytes, modified_at, parse_status.
    A document is discovered, or active if its id is among ``active`` (doc_id); what can't be read says so.
    """
    accepted, _ = normalize_documents(raw.drop("doc_id"), "private")
    path, relative = F.coalesce(_known(raw, "path"), F.lit("")), F.coalesce(F.col("relative_path"), F.lit(""))
    source = F.coalesce(_filled("source"), F.lit("manual_upload"))
    name = F.regexp_extract(F.coalesce(_filled(path), relative), r"([^/\\]*)$", 1)
    folder = F.when(relative != "", F.split(F.replace(relative, F.lit("/"), F.lit("\\")), r"\\")[0]).otherwise("")
    parse = F.coalesce(_filled(_known(raw, "parse_status")), F.lit("ready"))
    made = accepted.withColumn("doc_id", keys.catalog_id(source, F.coalesce(_filled(path), relative))).withColumn("file_name", name)
    made = made.withColumn("file_type", F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)))
    config = profiles.recommended_chunking(F.col("file_type"), F.col("title"), F.col("body"))
    known = active.select("doc_id", F.lit("active").alias("__active")).distinct() if active is not None else None
    made = made.join(known, "doc_id", "left") if known is not None else made.withColumn("__active", F.lit(None).cast("string"))
    return made.select(
        "doc_id", "content_hash", "title", "body", F.coalesce(_known(raw, "summary"), F.lit("")).alias("summary"), F.lit("private").alias("visibility"),
        F.coalesce(_filled(_known(raw, "space_id")), F.lit("portfolio")).alias("space_id"), F.when(parse.isin(*UNREADABLE), parse).otherwise(F.coalesce("__active", F.lit("discovered"))).alias("status"),
        source.alias("source"), path.alias("source_path"), relative.alias("relative_path"), F.coalesce(_filled(_known(raw, "project")), folder).alias("project"), "file_name", "file_type",
        F.coalesce(_known(raw, "size_bytes", "bigint"), F.lit(0).cast("bigint")).alias("size_bytes"), _known(raw, "modified_at").alias("modified_at"), parse.alias("parse_status"), "language",
        config["strategy"].alias("chunk_strategy"), config["size"].alias("chunk_size"), config["overlap"].alias("chunk_overlap"), F.lit("tokens").alias("chunk_unit"),
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def keep_first(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row for each key, the first in the given order. Found by a grouped minimum, not by a sort of each group."""
    columns = df.columns
    rest = F.struct(*(F.col(c) for c in columns))
    best = df.groupBy(key).agg(F.min_by(rest, F.struct(*order)).alias("__row"))
    return best.select(*(F.col(f"__row.{c}").alias(c) for c in columns))


def keep_last(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    columns = df.columns
    best = df.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in columns)), F.struct(*order)).alias("__row"))
    return best.select(*(F.col(f"__row.{c}").alias(c) for c in columns))


def duplicate_groups(df: DataFrame, key: str = "content_hash", id_: str = "doc_id") -> DataFrame:
    """Groups of equal keys: their number and smallest and largest id (the ids themselves by a join back)."""
    filled = df.filter(F.length(F.trim(F.coalesce(F.col(key), F.lit("")))) > 0)
    return filled.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min(id_).alias("first_id"), F.max(id_).alias("last_id")).filter("copies > 1")


def matching(df: DataFrame, equal: dict[str, str | None], search: str | None = None, columns: tuple[str, ...] = SEARCHABLE) -> DataFrame:
    """Rows by equality on FILTERABLE columns (None, "" and "all" don't filter) and a substring in any of some columns.

    The substring ignores ASCII case only, and % and _ stay wildcards. Other columns don't filter.
    """
    tests = [F.col(c) == v for c, v in equal.items() if c in FILTERABLE and v not in (None, "", "all")]
    if search and search.strip():
        fold = lambda c: F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        tests.append(reduce(Column.__or__, (fold(F.col(c)).like(f"%{''.join(x.lower() if x.isascii() else x for x in search.strip())}%") for c in columns)))
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def matching_count(df: DataFrame, equal: dict[str, str | None], search: str | None = None) -> DataFrame:
    """The number of matching rows, from which pages are counted."""
    return matching(df, equal, search).agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page by newest change (without one last), then title and id; the size is held within 1..100."""
    size = min(100, max(1, size))
    return df.orderBy(F.col("modified_at").desc_nulls_last(), F.col("title"), F.col("doc_id")).offset((max(1, number) - 1) * size).limit(size)


def active_documents(documents: DataFrame, spaces: DataFrame) -> DataFrame:
    """Active documents of active spaces, body replaced by the summary where there is one, all private."""
    open_ = spaces.filter("status = 'active'").select("space_id", F.col("space_name"))
    made = documents.filter("status = 'active'").join(open_, "space_id")
    return made.withColumn("body", F.coalesce(F.when(F.length("summary") > 0, F.col("summary")), F.col("body"))).withColumn("visibility", F.lit("private"))


def knowledge_union(public: DataFrame, private: DataFrame) -> DataFrame:
    """Public rows before private ones, with an explicit order for keep-first."""
    return public.withColumn("source_order", F.lit(0)).unionByName(private.withColumn("source_order", F.lit(1)), allowMissingColumns=True)


def space_counts(documents: DataFrame, spaces: DataFrame) -> DataFrame:
    """Every space with the number of its documents; counted before the join, so a large space is no hot key."""
    counts = documents.groupBy("space_id").agg(F.count(F.lit(1)).alias("documents"))
    return spaces.join(counts, "space_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def upsert(existing: DataFrame, incoming: DataFrame, order: str = "updated_at") -> DataFrame:
    """The next snapshot: new values win except in KEPT_ON_UPSERT.

    Of several new rows of an id the last by ``order`` gives the values that win, and the first, if the id is new, those
    that are kept.
    """
    columns = existing.columns
    kinds = dict(incoming.dtypes)
    ties = [c for c in columns if c not in ("doc_id", order) and kinds[c] in ("string", "int", "bigint")]
    rest = F.struct(*(F.col(c) for c in columns))
    place = F.struct(order, *ties)
    latest = incoming.groupBy("doc_id").agg(F.max_by(rest, place).alias("last"), F.min_by(rest, place).alias("first"))
    a, b = existing.alias("a"), latest.alias("b")
    joined = a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full_outer")
    known, fresh = F.col("a.doc_id").isNotNull(), F.col("b.doc_id").isNotNull()
    value = lambda c: F.when(known & (F.lit(c in KEPT_ON_UPSERT) | ~fresh), F.col(f"a.{c}")).otherwise(F.col(f"b.{'first' if c in KEPT_ON_UPSERT else 'last'}.{c}")).alias(c)
    return joined.select(*(F.coalesce("a.doc_id", "b.doc_id").alias(c) if c == "doc_id" else value(c) for c in columns))


def overwrite_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by ``order`` stays, in the place (position) of the first."""
    columns = df.columns
    made = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order)).alias("row"), F.min(order).alias("position"))
    return made.select(*(F.col(f"row.{c}").alias(c) for c in columns), "position")


def update_rows(documents: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """The next snapshot after changes (doc_id and any of status, summary, chunk settings, profile): set where not null.

    Changed rows get ``now`` as updated_at; ids that aren't there change nothing; of several changes of an id the largest holds.
    """
    named = [c for c in changes.columns if c != "doc_id"]
    once = changes.groupBy("doc_id").agg(*(F.max(c).alias(f"__{c}") for c in named))
    made = documents.join(once.withColumn("__changed", F.lit(now)), "doc_id", "left")
    value = lambda c: F.coalesce(f"__{c}", c) if c in named else F.coalesce("__changed", c) if c == "updated_at" else F.col(c)
    return made.select(*(value(c).alias(c) for c in documents.columns))


def profile_change(profile: profiles.Profile) -> dict[str, Column]:
    """The columns that choosing a profile sets, for update_rows."""
    strategy = "resume_semantic" if profile.chunk_mode == "resume_semantic" else "recursive"
    return {
        "profile_version": F.lit(1), "processing_profile_hash": F.lit(profile.digest()), "chunk_strategy": F.lit(strategy),
        "chunk_size": F.lit(profile.max_tokens), "chunk_overlap": F.lit(profile.overlap_tokens), "chunk_unit": F.lit("tokens"),
    }


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after publishing: those of republished documents go, the new ones come."""
    return chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def move_space(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """Space of the chunks of moved documents (doc_id, space_id), everything else untouched."""
    to = moves.select("doc_id", F.col("space_id").alias("__to"))
    return chunks.join(to, "doc_id", "left").withColumn("space_id", F.coalesce("__to", "space_id")).select(chunks.columns)


def index_states(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """indexed, outdated or not_indexed for every document: all chunks carry its hash, some another, or there are none."""
    have = chunks.filter("doc_id is not null").groupBy("doc_id").agg(F.min("content_hash").alias("least"), F.max("content_hash").alias("most"))
    same = (F.col("least") == F.col("most")) & (F.col("least") == F.col("content_hash"))
    state = F.when(F.col("most").isNull(), "not_indexed").when(same, "indexed").otherwise("outdated")
    return documents.select("doc_id", "content_hash").join(have, "doc_id", "left").select("doc_id", state.alias("state"))


def top_per_project(df: DataFrame, most: int = 2, project: str = "project") -> DataFrame:
    """The first documents of every project by path."""
    number = F.row_number().over(W.partitionBy(project).orderBy("relative_path", "doc_id"))
    return df.filter(F.length(project) > 0).withColumn("place", number).filter(F.col("place") <= most)


#: Parts of paths that are no résumés, and files of projects that come first.
NOISE = ("phpstudy_pro", "\\extensions\\", "\\errorpages\\", "\\www\\error\\")
PROJECT_FILES = ("package.json", "pyproject.toml", "requirements.txt", "architecture.md")


def select_private(df: DataFrame, per_project: int = 2, resumes: int = 12, *, resume_source: str = "resume_root", project_source: str = "project_activity_root") -> DataFrame:
    """Scanned documents that are worth keeping: the best of every project, the best résumés, and all from other sources.

    Project files rank readmes, then pages of docs, then build files, then code and text, by path within; résumés rank
    master copies first and Word before Markdown. Columns: doc_id, source, relative_path; a project is a path's first part.
    """
    path = F.lower(F.replace(F.coalesce("relative_path", F.lit("")), F.lit("/"), F.lit("\\")))
    name = F.regexp_extract(path, r"([^\\]*)$", 1)
    ends = lambda *endings: reduce(Column.__or__, (F.endswith(name, F.lit(e)) for e in endings))
    docs = F.contains(F.concat(F.lit("\\"), path), F.lit("\\docs\\")) & ends(".md")
    in_project = F.when(F.startswith(name, F.lit("readme")), 0).when(docs, 1).when(name.isin(*PROJECT_FILES), 2).when(ends(".md", ".py", ".ts", ".tsx", ".js"), 3).otherwise(4)
    master = F.contains(path, F.lit("master"))
    in_resumes = F.when(master & ends(".docx"), 0).when(master & ends(".md"), 1).when(ends(".docx"), 2).when(ends(".md"), 3).otherwise(4)
    kind = F.when(F.col("source") == resume_source, "resume").when((F.col("source") == project_source) & F.lit(per_project > 0), "project").otherwise("other")
    rows = df.withColumn("kind", kind).withColumn("group", F.when(kind == "project", F.split(path, r"\\")[0]).otherwise(""))
    rows = rows.withColumn("rank", F.when(kind == "resume", in_resumes).when(kind == "project", in_project)).withColumn("path", path)
    noisy = reduce(Column.__or__, (F.contains(path, F.lit(part)) for part in NOISE))
    ranked = rows.filter((kind == "project") | ((kind == "resume") & ~noisy))
    number = F.row_number().over(W.partitionBy("kind", "group").orderBy("rank", "path", "doc_id"))
    best = ranked.withColumn("place", number).filter(F.col("place") <= F.when(F.col("kind") == "resume", resumes).otherwise(per_project))
    others = rows.filter(kind == "other").withColumn("place", F.lit(None).cast("int"))
    return others.unionByName(best).select(*df.columns, "kind", "place")


def latest_versions(df: DataFrame) -> DataFrame:
    """The newest member of each version group by (modified_at, updated_at), missing ones first."""
    order = F.struct(F.coalesce("modified_at", F.lit("")), F.coalesce("updated_at", F.lit("")), F.col("doc_id"))
    return df.filter("version_group_id is not null").groupBy("version_group_id").agg(F.max_by("doc_id", order).alias("doc_id"), F.count(F.lit(1)).alias("members"))


def last_turns(messages: DataFrame, turns: int = 12) -> DataFrame:
    """The last messages of every session in time order, deliveries twice counted once.

    A long session's rows are cut to its last ones in each partition before they meet (a window group limit).
    """
    once = messages.dropDuplicates(["message_id"])
    number = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("sent_at").desc(), F.col("message_id").desc()))
    return once.withColumn("from_end", number).filter(F.col("from_end") <= turns)


def fingerprint(df: DataFrame, *key: str, exclude: tuple[str, ...] = ("embedding",), parts: int = 256) -> DataFrame:
    """An order-free fingerprint of a table: counts and hashes of ``parts`` slices of its rows, hashed again.

    Rows are hashed one by one and combined by sums, so that no list of all rows is ever built.
    """
    columns = sorted(c for c in df.columns if c not in exclude)
    text = F.concat_ws("\u001f", *(F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("null")) for c in columns))
    rows = df.select(F.pmod(F.xxhash64(*key), F.lit(parts)).alias("part"), F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)").alias("h"))
    slices = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "h"))), lambda s: F.concat_ws(":", s["part"].cast("string"), s["n"].cast("string"), s["h"].cast("string"))), "\n")
    return slices.agg(F.sum("n").alias("rows"), F.sha2(whole, 256).alias("fingerprint"))


def public_search(documents: DataFrame, words: str = "", most: int = 100, *, spaces: tuple[str, ...] | None = None, category: str | None = None, status: str = "active") -> DataFrame:
    """The newest public documents of a status, spaces and category with a substring, case ignored, in title or summary; wildcards are plain."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    found = documents.filter((F.col("status") == status) & (F.col("visibility") == "public") & F.contains(text, F.lit(words.lower())))
    found = found if not spaces else found.filter(F.col("space_id").isin(*spaces))
    found = found if not category else found.filter(F.col("category") == category)
    return found.orderBy(F.col("updated_at").desc(), "doc_id").limit(most)


def library_search(documents: DataFrame, words: str) -> DataFrame:
    """Public documents with a substring, case ignored, in title and body together."""
    return documents.filter(F.contains(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))), F.lit(words.lower())))


def valid_only(rows: DataFrame) -> DataFrame:
    """Rows that are active, or say nothing about it."""
    return rows.filter(F.coalesce("validity_status", F.lit("active")) == "active")


def in_spaces(rows: DataFrame, spaces: tuple[str, ...], active_only: bool = False) -> DataFrame:
    """Rows of some spaces, those of one space by equality, and of active ones alone if wanted."""
    found = rows.filter(F.col("space_id") == spaces[0]) if len(spaces) == 1 else rows.filter(F.col("space_id").isin(*spaces))
    return found.filter("status = 'active'") if active_only else found


def public_documents(documents: DataFrame, spaces: DataFrame) -> DataFrame:
    """What readers may see of published documents: nine columns with their defaults, names of spaces looked up."""
    names = spaces.select("space_id", "space_name")
    made = documents.drop("space_name").join(names, "space_id", "left")
    text = lambda name, default: F.coalesce(_filled(_known(documents, name)), F.lit(default)).alias(name)
    url = _known(documents, "source_url")
    return made.select(
        "doc_id", F.coalesce(_filled("space_id"), F.lit("portfolio")).alias("space_id"), F.coalesce("space_name", F.lit("Portfolio")).alias("space_name"), text("title", "Untitled"), text("summary", ""),
        text("category", "portfolio"), F.when(F.col("language") == "zh", "zh").otherwise("en").alias("language"), F.col("updated_at"), F.when(url.rlike(r"(?i)^\s*https?://[^/?#\s]+"), url).alias("source_url"),
    )


#: Columns that an owner's export leaves out.
NOT_EXPORTED = ("_id", "embedding", "owner_id", "owner_email")


def owner_export(rows: DataFrame) -> DataFrame:
    return rows.drop(*NOT_EXPORTED)


def source_view(chunks: DataFrame, most: int = 1200) -> DataFrame:
    """What a reader may see of a chunk: allowed columns of public, valid rows, the text (the parent's if there is one) cut to a snippet."""
    text = F.coalesce(_filled(_known(chunks, "parent_body")), _filled("raw_body"), F.lit(""))
    rows = chunks if "validity_status" not in chunks.columns else valid_only(chunks)
    return rows.filter("visibility = 'public' and chunk_id is not null").select("chunk_id", "doc_id", "parent_chunk_id", "semantic_group_id", "section_type", "space_id", F.substring(text, 1, most).alias("snippet"))


def unique_slugs(spaces: DataFrame, name: str = "space_name", order: str = "space_id") -> DataFrame:
    """An id for each name: its slug, and from the second space with the same slug on a number behind it. A small table."""
    number = F.row_number().over(W.partitionBy("__slug").orderBy(order))
    made = spaces.withColumn("__slug", slugify(F.coalesce(F.col(name), F.lit("")))).withColumn("__n", number)
    return made.withColumn("slug", F.when(F.col("__n") == 1, F.col("__slug")).otherwise(F.concat("__slug", F.lit("-"), F.col("__n")))).drop("__slug", "__n")


def version_inputs(documents: DataFrame) -> DataFrame:
    """Active manual uploads with what version groups are made of: the title from the file name, where there is one."""
    title = F.when(F.length(F.coalesce("file_name", F.lit(""))) > 0, file_stem(F.col("file_name"))).otherwise(file_stem(F.coalesce("title", F.lit(""))))
    return documents.filter("source = 'manual_upload' and status = 'active'").select("doc_id", "space_id", title.alias("title"), "body")


def ordered_spaces(spaces: DataFrame, first: str = "portfolio") -> DataFrame:
    """Spaces with their places: one first, the others by name. A dimension table of a few rows."""
    order = W.orderBy(F.when(F.col("space_id") == first, 0).otherwise(1), "space_name", "space_id")
    return spaces.withColumn("place", F.row_number().over(order))


def profile_states(documents: DataFrame) -> DataFrame:
    """Whether the stored hash of each processing profile is that of its stored text."""
    known = documents.filter("processing_profile_json is not null")
    return known.select("doc_id", (F.sha2(F.col("processing_profile_json"), 256) == F.col("processing_profile_hash")).alias("hash_matches"))
