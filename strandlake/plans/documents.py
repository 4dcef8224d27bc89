"""Queries of text functions, profiles and chunk records, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import read_table
from strandlake.functions import keys, profiles
from strandlake.functions import text as T
from strandlake.operators import catalog, chunking
from strandlake.plans.base import _SPACES, _TOKENS, _documents, register


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "catalog_documents")


_CASE = " ".join(f"when lower(coalesce(file_type, '')) in ({', '.join(map(repr, kinds))}) then {{{k}}}" for k, kinds in enumerate(profiles.LEGACY))


def _legacy(at: int) -> str:
    quoted = lambda row: f"'{row[at]}'" if at == 0 else str(row[at])
    return (
        f"case when lower(coalesce(file_type, '')) = 'docx' or contains(lower(coalesce(title, '')), 'resume') or contains(lower(coalesce(title, '')), '简历') then {quoted(profiles.LEGACY_RESUME)} "
        f"when starts_with(lower(coalesce(title, '')), 'readme') then {quoted(profiles.LEGACY['md', 'markdown'])} {_CASE.format(*map(quoted, profiles.LEGACY.values()))} "
        f"when lower(coalesce(file_type, '')) = 'json' and length(coalesce(body, '')) <= 800 then {quoted(profiles.LEGACY_SHORT)} else {quoted(profiles.LEGACY_DEFAULT)} end"
    )


@register(f"select doc_id, {_legacy(0)} as strategy, {_legacy(1)} as size, {_legacy(2)} as overlap from catalog_documents")
def recommended_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profiles.recommended_chunking(F.col("file_type"), F.col("title"), F.col("body"))
    return _catalog(spark, sf_dir).select("doc_id", made.alias("r")).select("doc_id", "r.*")


_UNSPACED = r"[\x{0e00}-\x{0e7f}\x{1100}-\x{11ff}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{31f0}-\x{31ff}\x{ac00}-\x{d7af}]+"
_ESTIMATE = rf"[\x{{3400}}-\x{{9fff}}]|[\p{{L}}\p{{N}}]+|[^{_SPACES}\p{{L}}\p{{N}}_]"
_SIZE = f"(len(regexp_extract_all(regexp_replace(coalesce(body, ''), '{_UNSPACED}', ' ', 'g'), '{_ESTIMATE}')) + coalesce(list_sum(list_transform(regexp_extract_all(coalesce(body, ''), '{_UNSPACED}'), lambda r: ceil(length(r) / 2.0))), 0)::bigint)"
_MARKED = r"regexp_matches(strip_accents(lower(coalesce({x}, ''))), '(^|[^a-z0-9])(resume|cv|curriculum[\s_-]+vitae)($|[^a-z0-9])|简历')"
_MODE = f"""case when file_type in ('csv', 'json') then 'general' when file_type in ('docx', 'pdf', 'md', 'markdown', 'txt') and ({_MARKED.replace('{x}', 'title')} or {_MARKED.replace('{x}', 'file_name')} or source = 'resume_root') then 'resume_semantic'
 when file_type in ('pdf', 'md', 'markdown', 'txt', 'doc', 'docx', 'odt', 'rtf') and {_SIZE} > 2000 then 'parent_child' else 'general' end"""


@register(f"""select doc_id, {_SIZE} as estimated_tokens, {_MARKED.replace('{x}', 'title')} as is_resume, {_MODE} as mode,
 case {_MODE} when 'resume_semantic' then 0 when 'parent_child' then 20 else case when file_type = 'csv' or (file_type = 'json' and {_SIZE} <= 2000) then 0 else 80 end end as overlap from catalog_documents""")
def recommended_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = profiles.recommended(F.col("file_type"), F.col("title"), F.col("body"), F.col("file_name"), F.col("source"))
    rows = _catalog(spark, sf_dir).select("doc_id", T.estimated_tokens(F.col("body")).cast("bigint").alias("estimated_tokens"), T.is_resume(F.col("title")).alias("is_resume"), made.alias("p"))
    return rows.select("doc_id", "estimated_tokens", "is_resume", F.col("p.chunk_mode").alias("mode"), F.col("p.overlap_tokens").alias("overlap"))


_BOUNDS = "chunk_strategy in ('markdown', 'paragraph', 'recursive', 'resume_semantic') and chunk_unit in ('characters', 'tokens') and chunk_size between 200 and 2000 and chunk_overlap between 0 and chunk_size * 0.25"
_UNIT = "case when chunk_unit = 'characters' then ceil({x} / 4.0) else {x} end"
_MOST = f"greatest(200, least(2000, {_UNIT.replace('{x}', 'chunk_size')}))::integer"


@register(f"""select doc_id, case when not ({_BOUNDS}) then null when {_MARKED.replace('{x}', 'title')} or chunk_strategy = 'resume_semantic' then 'resume_semantic' else 'general' end as chunk_mode,
 case when not ({_BOUNDS}) then -1 when {_MARKED.replace('{x}', 'title')} or chunk_strategy = 'resume_semantic' then 320 else {_MOST} end as max_tokens,
 case when not ({_BOUNDS}) then -1 when {_MARKED.replace('{x}', 'title')} or chunk_strategy = 'resume_semantic' then 0 else least({_UNIT.replace('{x}', 'chunk_overlap')}, {_MOST} // 4)::integer end as overlap_tokens from catalog_documents""")
def legacy_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile that stored chunk settings stand for; null and -1 where they aren't valid."""
    made = profiles.from_legacy(F.col("title"), F.col("file_type"), F.col("chunk_strategy"), F.col("chunk_size"), F.col("chunk_overlap"), F.col("chunk_unit"))
    return _catalog(spark, sf_dir).select("doc_id", made.alias("p")).select("doc_id", "p.chunk_mode", F.coalesce("p.max_tokens", F.lit(-1)).alias("max_tokens"), F.coalesce("p.overlap_tokens", F.lit(-1)).alias("overlap_tokens"))


@register(f"""with p as (select doc_id, {_BOUNDS} as ok, {_MARKED.replace('{x}', 'title')} or chunk_strategy = 'resume_semantic' as resume, {_MOST} as most, least({_UNIT.replace('{x}', 'chunk_overlap')}, {_MOST} // 4)::integer as over from catalog_documents),
s as (select doc_id, case when resume then 'resume_semantic' else 'general' end as mode, case when resume then 320 else most end as most, case when resume then 0 else over end as over, case when resume then 320 else 700 end as parent, case when resume then 'semantic_section' else 'paragraph' end as pm from p where ok)
select doc_id, sha256('{{"child_max_tokens":180,"chunk_mode":"' || mode || '","delimiter":"\\n\\n","index_mode":"high_quality","max_tokens":' || most || ',"overlap_tokens":' || over || ',"parent_max_tokens":' || parent || ',"parent_mode":"' || pm || '","preprocessing":{{"normalize_whitespace":true,"remove_emails":false,"remove_urls":false}},"profile_version":1}}') as digest from s""")
def profile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the profiles that stored chunk settings stand for."""
    made = profiles.from_legacy(F.col("title"), F.col("file_type"), F.col("chunk_strategy"), F.col("chunk_size"), F.col("chunk_overlap"), F.col("chunk_unit"))
    return _catalog(spark, sf_dir).select("doc_id", made.alias("p")).filter("p is not null").select("doc_id", profiles.canonical_digest(F.col("p")).alias("digest"))


@register(r"""select doc_id, case when regexp_matches(concat_ws(chr(10), nullif(file_name, ''), nullif(title, ''), nullif(substr(body, 1, 500), '')), '(?i)简历|履历|curriculum\s+vitae|\bresume\b|\bcv\b') then 'resume_semantic' else 'parent_child' end as mode from catalog_documents""")
def public_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).select("doc_id", chunking.public_profile(F.col("file_name"), F.col("title"), F.col("body")).alias("mode"))


@register()
def public_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cleaned as published ones are."""
    return _documents(spark, sf_dir).select("doc_id", F.sha2(T.clean_public(F.col("text"), urls=True, emails=True), 256).alias("clean_hash"))


@register()
def scan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cleaned as a folder scan cleans: no markup, all white space single."""
    return _documents(spark, sf_dir).select("doc_id", F.sha2(T.clean_flat(F.col("text")), 256).alias("clean_hash"))


@register(r"""select doc_id, coalesce(regexp_matches(text, '[\x{4e00}-\x{9fff}]'), false) as has_han from documents""")
def han_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.coalesce(T.contains_han(F.col("text")), F.lit(False)).alias("has_han"))


@register(r"""select doc_id, case when s = '' then 'space' else s end as slug, coalesce(regexp_matches(body, '\x{fffd}|Ã[\x{80}-\x{bf}]|â€|锟斤拷'), false) as mojibake from (select doc_id, body, regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as s from catalog_documents)""")
def slugs_and_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).select("doc_id", T.slugify(F.coalesce("title", F.lit(""))).alias("slug"), T.is_mojibake(F.col("body")).alias("mojibake"))


@register()
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text of the corpus has data that blocks publication."""
    made = _documents(spark, sf_dir).select("doc_id", F.explode(T.public_pii_spans(F.coalesce("text", F.lit("")))).alias("s"))
    return made.select("doc_id", "s.kind", "s.start_pos", "s.end_pos")


@register(r"""select doc_id, 'phone' as kind, count(*) as mentions from (select doc_id, unnest(regexp_extract_all(regexp_replace(text, '\d{14,}', ' ', 'g'), '(?:^|[^\d])((?:\+?86[- ]?)?1[3-9]\d{9})(?:$|[^\d])', 1)) from documents where text is not null) group by all""")
def local_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese mobile numbers of every text, counted from the findings with their values."""
    made = _documents(spark, sf_dir).select("doc_id", F.explode(T.local_pii(F.col("text"))).alias("f")).filter("f.kind = 'phone'")
    return made.groupBy("doc_id", F.col("f.kind").alias("kind")).agg(F.count(F.lit(1)).alias("mentions"))


@register("""select doc_id, 'local_' || substr(sha256(coalesce(source, '') || '|' || replace(lower(coalesce(relative_path, '')), '/', chr(92))), 1, 24) as catalog_id,
 'owner_' || substr(sha256(coalesce(source, '') || ':' || doc_id), 1, 24) as owner_id, 'parent_' || substr(sha256(doc_id || chr(10) || '0' || chr(10) || coalesce(body, '')), 1, 20) as parent_id, doc_id || '_chunk_0_' || substr(sha256(body), 1, 10) as chunk_id from catalog_documents""")
def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.lit(0)
    return _catalog(spark, sf_dir).select(
        "doc_id", keys.catalog_id(F.col("source"), F.coalesce("relative_path", F.lit(""))).alias("catalog_id"), keys.owner_document_id(F.col("source"), F.col("doc_id")).alias("owner_id"),
        keys.parent_id(F.col("doc_id"), first, F.col("body")).alias("parent_id"), keys.chunk_id(F.col("doc_id"), first, F.col("body")).alias("chunk_id"),
    )


@register()
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of the active catalog: of equal bodies the first by title, each cut by its own profile."""
    rows = _catalog(spark, sf_dir).filter("status = 'active'")
    made = chunking.chunk_records(rows, F.coalesce("title", F.lit("")))
    columns = ("doc_id", "chunk_id", "parent_chunk_id", "semantic_group_id", "section_type", "retrieval_priority", "space_id", "visibility", "token_count", "character_count", "processing_profile_hash")
    return made.select(*columns, F.sha2("retrieval_text", 256).alias("text_hash"))


@register(f"""select doc_id, count(*) as chunks, sum({_TOKENS.replace('{x}', 'raw_body')})::bigint as tokens from chunks group by 1""")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks and their tokens of every document."""
    return read_table(spark, sf_dir, "chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(T.count_tokens(F.col("raw_body"))).alias("tokens"))


@register()
def chunk_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and children of every catalog document under its recommended profile, numbered as in a contract."""
    rows = _catalog(spark, sf_dir)
    profile = profiles.recommended(F.col("file_type"), F.col("title"), F.col("body"), F.col("file_name"), F.col("source"))
    made = chunking.contract(chunking.chunk_tree(rows.select("doc_id", "title", "body", profile.alias("profile")), F.col("profile")))
    return made.select("doc_id", "parent_index", "child_index", "section_type", "entity_title", "retrieval_priority", "semantic_group_index", "token_count", F.sha2("raw_body", 256).alias("body_hash"))


@register()
def preview_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut as before publication, résumés by their sections."""
    rows = _documents(spark, sf_dir).select("doc_id", "title", T.clean_public(F.col("text")).alias("body"), "url")
    mode = chunking.public_profile(F.lit(""), F.col("title"), F.col("body"))
    made = chunking.preview_chunks(rows, mode)
    return made.select("doc_id", "parent_index", "child_index", "chunk_id", "semantic_group_id", "section_type", "token_count", "character_count")


@register()
def chunk_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of the pieces that every catalog body is cut into."""
    made = chunking.split_bodies(_catalog(spark, sf_dir).select("doc_id", "body"), size=320, overlap=0)
    return chunking.chunk_metrics(made).drop("semantic")


@register("""select doc_id, sha256('[' || concat_ws(' | ', case when trim(coalesce(title, '')) <> '' then 'Document: ' || title end, case when trim(coalesce(project, '')) <> '' then 'Project: ' || project end, 'Section: ' || coalesce(file_type, '-') || ' > ' || doc_id,
 case when not contains(coalesce(file_type, '-') || ' > ' || doc_id, space_id) then 'Entity: ' || space_id end, case when trim(coalesce(source, '')) <> '' then 'Source: ' || source end) || ']') as prefix_hash from catalog_documents""")
def entity_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes with a section path and an entity, here file type and space."""
    section = F.concat(F.coalesce("file_type", F.lit("-")), F.lit(" > "), "doc_id")
    line = chunking.context_prefix(F.col("title"), F.col("project"), section, F.col("source"), F.lit(None).cast("string"), F.col("space_id"))
    return _catalog(spark, sf_dir).select("doc_id", F.sha2(line, 256).alias("prefix_hash"))


@register()
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows made anew from the scanned columns."""
    raw = _catalog(spark, sf_dir).select("doc_id", "source", "relative_path", F.col("source_path").alias("path"), "title", "body", "project", "size_bytes", "modified_at", "parse_status", "parse_message", "summary", "space_id")
    active = _catalog(spark, sf_dir).filter("status = 'active'").select(keys.catalog_id(F.col("source"), F.coalesce(F.when(F.length("source_path") > 0, F.col("source_path")), F.col("relative_path"), F.lit(""))).alias("doc_id"))
    made = catalog.catalog_rows(raw, "2026-01-01T00:00:00+00:00", active)
    return made.select("doc_id", "title", "content_hash", "status", "file_name", "file_type", "project", "chunk_strategy", "chunk_size", "chunk_overlap", "language")
