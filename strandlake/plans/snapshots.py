"""Queries of catalog and publication snapshots, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import read_table
from strandlake.functions import keys
from strandlake.operators import catalog, publish
from strandlake.plans.base import _documents, register
from strandlake.streaming import rate


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "catalog_documents")


@register("""select count(*) as total from catalog_documents where parse_status = 'ready' and source = 'manual_upload' and (contains(translate(coalesce(title, ''), 'NOTES', 'notes'), 'notes') or contains(lower(coalesce(body, '')), 'notes') or contains(lower(coalesce(summary, '')), 'notes') or contains(lower(coalesce(source_path, '')), 'notes') or contains(lower(coalesce(relative_path, '')), 'notes'))""")
def catalog_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a catalog search over all of its columns has."""
    return catalog.matching_count(_catalog(spark, sf_dir), {"parse_status": "ready", "source": "manual_upload", "language": "en", "status": "all"}, " NOTES ")


@register("""select doc_id from catalog_documents where visibility = 'public' and contains(lower(coalesce(title, '') || ' ' || coalesce(body, '')), 'index')""")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.library_search(_catalog(spark, sf_dir).filter("visibility = 'public'"), "Index").select("doc_id")


@register("""select doc_id, space_id from catalog_documents where space_id in ('lab-notes', 'portfolio') and status = 'active'""")
def documents_of_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.in_spaces(_catalog(spark, sf_dir), ("lab-notes", "portfolio"), active_only=True).select("doc_id", "space_id")


@register("""select doc_id, coalesce(nullif(d.space_id, ''), 'portfolio') as space_id, coalesce(space_name, 'Portfolio') as space_name, coalesce(nullif(title, ''), 'Untitled') as title, case when language = 'zh' then 'zh' else 'en' end as language
 from catalog_documents d left join knowledge_spaces s on s.space_id = d.space_id where visibility = 'public' and d.status = 'active'""")
def public_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalog(spark, sf_dir).filter("visibility = 'public' and status = 'active'")
    return catalog.public_documents(rows, read_table(spark, sf_dir, "knowledge_spaces")).select("doc_id", "space_id", "space_name", "title", "language")


@register("""with p as (select doc_id, source, lower(replace(coalesce(relative_path, ''), '/', chr(92))) as path from catalog_documents),
n as (select *, regexp_extract(path, '([^\\\\]*)$', 1) as name, case source when 'course_backup' then 'resume' when 'repo_mirror' then 'project' else 'other' end as kind from p),
r as (select *, case when kind = 'project' then split_part(path, chr(92), 1) else '' end as grp, case when kind = 'project' then case when starts_with(name, 'readme') then 0 when contains(chr(92) || path, chr(92) || 'docs' || chr(92)) and ends_with(name, '.md') then 1
 when name in ('package.json', 'pyproject.toml', 'requirements.txt', 'architecture.md') then 2 when regexp_matches(name, '\\.(md|py|ts|tsx|js)$') then 3 else 4 end
 else case when contains(path, 'master') and ends_with(name, '.docx') then 0 when contains(path, 'master') and ends_with(name, '.md') then 1 when ends_with(name, '.docx') then 2 when ends_with(name, '.md') then 3 else 4 end end as rnk from n),
k as (select *, row_number() over (partition by kind, grp order by rnk, path, doc_id)::integer as place from r where kind <> 'other')
select doc_id, kind, place from k where place <= case when kind = 'resume' then 12 else 2 end union all select doc_id, kind, 0 from r where kind = 'other'""")
def private_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files a project (of the mirrored repositories), twelve résumés (of the course backup), everything else."""
    rows = _catalog(spark, sf_dir).select("doc_id", "source", "relative_path")
    return catalog.select_private(rows, resume_source="course_backup", project_source="repo_mirror").select("doc_id", "kind", F.coalesce("place", F.lit(0)).alias("place"))


@register("""select max_by(doc_id, doc_id) as doc_id, min(doc_id) as position, count(*) as rows_of_body from documents where text is not null group by sha256(text)""")
def kept_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the last, in the place of the first."""
    rows = _documents(spark, sf_dir).filter("text is not null").select("doc_id", keys.content_hash(F.col("text")).alias("h"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows_of_body"))
    return catalog.overwrite_by_key(rows, "h", "doc_id").join(counts, "h").select("doc_id", "position", "rows_of_body")


@register("""select d.doc_id, case when c.doc_id is not null then 'excluded' else d.status end as status, case when c.doc_id is not null then 'short: ' || d.title else d.summary end as summary, case when c.doc_id is not null then '2026-01-01' else d.updated_at end as updated_at
 from catalog_documents d left join (select doc_id from catalog_documents where length(body) < 200 and title is not null) c using (doc_id)""")
def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents get another status and a summary; all others stay."""
    rows = _catalog(spark, sf_dir)
    changes = rows.filter("length(body) < 200 and title is not null").select("doc_id", F.lit("excluded").alias("status"), F.concat(F.lit("short: "), "title").alias("summary"))
    return catalog.update_rows(rows, changes, "2026-01-01").select("doc_id", "status", "summary", "updated_at")


@register("""with gone as (select distinct doc_id from catalog_documents where status = 'excluded' and doc_id is not null)
select chunk_id, doc_id, space_id from chunks where doc_id is null or doc_id not in (select doc_id from gone) union all select 'new_' || doc_id, doc_id, 'archive' from gone""")
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of excluded documents give way to one new chunk each."""
    gone = _catalog(spark, sf_dir).filter("status = 'excluded'").select("doc_id").distinct()
    new = gone.select(F.concat(F.lit("new_"), "doc_id").alias("chunk_id"), "doc_id", F.lit("archive").alias("space_id"))
    return catalog.replace_chunks(read_table(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "space_id"), new)


@register("""select space_id, case when n = 1 then s else s || '-' || n end as slug from (select space_id, s, row_number() over (partition by s order by space_id) as n from (select space_id, case when t = '' then 'space' else t end as s from (select space_id, regexp_replace(regexp_replace(lower(trim(coalesce(split_part(space_name, ' ', 1), ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as t from knowledge_spaces)))""")
def space_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of spaces from the first word of their names, numbered where several have the same."""
    named = read_table(spark, sf_dir, "knowledge_spaces").withColumn("first", F.split("space_name", " ")[0])
    return catalog.unique_slugs(named, "first").select("space_id", "slug")


@register("""select chunk_id, doc_id from chunks where updated_at + interval 7 day > timestamptz '2025-01-01 00:00:00+00'""")
def unexpired_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that haven't expired, seven days after their last change, on a given day."""
    rows = read_table(spark, sf_dir, "chunks").withColumn("expires", F.col("updated_at") + F.expr("interval 7 days"))
    return rate.unexpired(rows, "expires", "2025-01-01 00:00:00").select("chunk_id", "doc_id")


@register()
def edited_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in capitals: same ids, new hashes; blank ones stay as they are."""
    rows = _catalog(spark, sf_dir)
    made = catalog.replace_bodies(rows, rows.select("doc_id", F.upper("body").alias("body")))
    return made.select("doc_id", "content_hash", "language", F.length("body").alias("chars"))


@register()
def public_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public corpus after every active catalog document was offered to it: bodies that it has aren't added."""
    known, _ = catalog.normalize_documents(read_table(spark, sf_dir, "portfolio_docs").select("doc_id", "title", "body"), "public")
    made, _ = publish.add_public(known, _catalog(spark, sf_dir).filter("status = 'active'").select("doc_id", "title", "body"))
    return made.select("doc_id", "title", "content_hash", "visibility")


@register()
def seed_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the public corpus from being seeded."""
    return publish.seed(read_table(spark, sf_dir, "portfolio_docs"))[1]


@register()
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog documents as publications with the chunks of their preview."""
    from strandlake.functions import text as T
    from strandlake.operators import chunking

    rows = _catalog(spark, sf_dir).filter("status = 'active' and visibility = 'public'").select("doc_id", "title", "summary", "space_id", "language", T.clean_public(F.col("body")).alias("body"), "source")
    chunks = chunking.preview_chunks(rows, chunking.public_profile(F.lit(""), F.col("title"), F.col("body"))).withColumn("draft_id", F.col("doc_id"))
    drafts = rows.select(F.col("doc_id").alias("draft_id"), F.col("source").alias("owner_id"), "title", "summary", F.lit("").alias("category"), "language", "body", F.lit(0).alias("version"), "space_id", F.lit(None).cast("string").alias("url"))
    return publish.publication(drafts, chunks, "2026-01-01T00:00:00Z")[1].select("doc_id", "chunk_id", "parent_chunk_id", "space_id", "section_type", "token_count", "publication_version", "content_hash")
