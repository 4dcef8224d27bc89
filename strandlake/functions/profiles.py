"""Processing profiles: how a document is cut. Presets, recommendations by kind and size, and which of them holds."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.text import estimated_tokens, folded_identity, is_resume

FIELDS = "chunk_mode string, max_tokens int, overlap_tokens int, parent_mode string, parent_max_tokens int, child_max_tokens int"
#: Bounds of settings, the size from which a document is long, and kinds of files.
LEAST_TOKENS, MOST_TOKENS, LONG = 200, 2000, 2000
RESUME_TYPES, LONG_TYPES = ("docx", "pdf", "md", "markdown", "txt"), ("pdf", "md", "markdown", "txt", "doc", "docx", "odt", "rtf")
STRATEGIES, UNITS = ("markdown", "paragraph", "recursive", "resume_semantic"), ("characters", "tokens")
#: Strategy, size and overlap by type of file, as recommended before there were profiles.
LEGACY = {
    ("md", "markdown"): ("markdown", 800, 80),
    ("txt",): ("paragraph", 700, 70),
    ("pdf",): ("recursive", 800, 100),
    ("csv",): ("recursive", 800, 0),
    ("py", "js", "ts", "tsx", "html", "htm"): ("recursive", 900, 80),
}
LEGACY_RESUME, LEGACY_DEFAULT, LEGACY_SHORT, SHORT_JSON = ("resume_semantic", 320, 0), ("recursive", 800, 80), ("recursive", 800, 0), 800

#: Settings that all profiles share; they are part of a profile's digest.
FIXED = {"profile_version": 1, "delimiter": "\n\n", "index_mode": "high_quality", "preprocessing": {"normalize_whitespace": True, "remove_urls": False, "remove_emails": False}}


@dataclass(frozen=True)
class Profile:
    """One preset; ``digest`` names its whole setting."""

    chunk_mode: str = "general"
    max_tokens: int = 800
    overlap_tokens: int = 80
    parent_mode: str = "paragraph"
    parent_max_tokens: int = 700
    child_max_tokens: int = 180

    def column(self) -> Column:
        return F.struct(*(F.lit(v).alias(k) for k, v in asdict(self).items()))

    def digest(self) -> str:
        return sha256(json.dumps(asdict(self) | FIXED, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


GENERAL = Profile()
WHOLE_RECORDS = Profile(overlap_tokens=0)
PARENT_CHILD = Profile("parent_child", 180, 20)
RESUME = Profile("resume_semantic", 320, 0, "semantic_section", 320)


def canonical_digest(profile: Column) -> Column:
    """The digest of a column of profiles: the hash of their settings as JSON with sorted keys."""
    text = lambda name: F.concat(F.lit(f'"{name}":"'), profile[name], F.lit('"'))
    number = lambda name: F.concat(F.lit(f'"{name}":'), profile[name].cast("string"))
    parts = {name: text(name) if name.endswith("mode") else number(name) for name in asdict(GENERAL)} | {k: F.lit(f'"{k}":{json.dumps(v, sort_keys=True, separators=(",", ":"))}') for k, v in FIXED.items()}
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *(parts[k] for k in sorted(parts))), F.lit("}")), 256)


def recommended(file_type: Column, title: Column, body: Column, file_name: Column | None = None, source: Column | None = None) -> Column:
    """The profile that a document's type, names and size call for.

    Records in csv are never résumés and stay whole, json goes by its size alone; a résumé has a type of text file and
    a marker in its title or file name, or comes from the résumé folder; only long texts get parents and children.
    Null texts count as empty. Without a type, the file name's ending is taken.
    """
    name = F.coalesce(file_name, F.lit("")) if file_name is not None else F.lit("")
    base, ending = F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^.]\.([^./\\]+)$"
    kind = F.regexp_replace(F.lower(F.coalesce(file_type, F.lit(""))), r"^\.+", "")
    kind = F.when(kind == "", F.lower(F.regexp_extract(base, ending, 1))).otherwise(kind)
    named = is_resume(base) & F.lower(F.regexp_extract(base, ending, 1)).isin(*RESUME_TYPES)
    rooted = F.trim(folded_identity(source)) == "resume_root" if source is not None else F.lit(False)
    long = estimated_tokens(body) > LONG
    return (
        F.when(kind == "csv", WHOLE_RECORDS.column())
        .when((kind == "json") & ~long, WHOLE_RECORDS.column())
        .when(kind == "json", GENERAL.column())
        .when(kind.isin(*RESUME_TYPES) & (F.coalesce(rooted, F.lit(False)) | is_resume(title) | named), RESUME.column())
        .when(kind.isin(*LONG_TYPES) & long, PARENT_CHILD.column())
        .otherwise(GENERAL.column())
    )


def recommended_chunking(file_type: Column, title: Column, body: Column) -> Column:
    """Strategy, size and overlap in tokens by type of file and title, as recommended before there were profiles."""
    row = lambda s: F.struct(F.lit(s[0]).alias("strategy"), F.lit(s[1]).alias("size"), F.lit(s[2]).alias("overlap"))
    kind, name = F.lower(F.coalesce(file_type, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    made = F.when((kind == "docx") | F.contains(name, F.lit("resume")) | F.contains(name, F.lit("简历")), row(LEGACY_RESUME)).when(F.startswith(name, F.lit("readme")), row(LEGACY["md", "markdown"]))
    made = reduce(lambda c, item: c.when(kind.isin(*item[0]), row(item[1])), LEGACY.items(), made)
    short = (kind == "json") & (F.length(F.coalesce(body, F.lit(""))) <= SHORT_JSON)
    return made.when(short, row(LEGACY_SHORT)).otherwise(row(LEGACY_DEFAULT))


def from_legacy(title: Column, file_type: Column, strategy: Column, size: Column, overlap: Column, unit: Column) -> Column:
    """The profile of stored chunk settings; null where these aren't valid.

    Characters become tokens by four, sizes are held within their bounds, the overlap to a quarter of the size.
    """
    kind, measure = F.lower(F.trim(strategy)), F.lower(F.trim(unit))
    valid = kind.isin(*STRATEGIES) & measure.isin(*UNITS) & size.between(LEAST_TOKENS, MOST_TOKENS) & (overlap >= 0) & (overlap <= size * 0.25)
    tokens = lambda value, least: F.greatest(F.lit(least), F.least(F.lit(MOST_TOKENS), F.when(measure == "characters", F.ceil(value / 4)).otherwise(value))).cast("int")
    most = tokens(size, LEAST_TOKENS)
    plain = F.struct(
        F.lit(GENERAL.chunk_mode).alias("chunk_mode"), most.alias("max_tokens"), F.least(tokens(overlap, 0), F.floor(most / 4)).cast("int").alias("overlap_tokens"),
        F.lit(GENERAL.parent_mode).alias("parent_mode"), F.lit(GENERAL.parent_max_tokens).alias("parent_max_tokens"), F.lit(GENERAL.child_max_tokens).alias("child_max_tokens"),
    )
    resume = (kind == "resume_semantic") | is_resume(title) | is_resume(F.regexp_extract(F.coalesce(file_type, F.lit("")), r"([^/\\]*)$", 1))
    return F.when(valid & resume, RESUME.column()).when(valid, plain)


def stored(text: Column) -> Column:
    """The profile of a stored JSON text, missing settings as in GENERAL; null if its settings aren't valid."""
    read = F.from_json(text, FIELDS)
    default = lambda name: F.coalesce(read[name], F.lit(getattr(GENERAL, name))).alias(name)
    made = F.struct(*(default(n) for n in asdict(GENERAL)))
    nested = made["chunk_mode"] == "parent_child"
    budget = F.when(nested, made["child_max_tokens"]).otherwise(made["max_tokens"])
    valid = (
        made["chunk_mode"].isin("general", "parent_child", "resume_semantic")
        & made["parent_mode"].isin("paragraph", "full_document", "semantic_section")
        & made["max_tokens"].between(F.when(nested, 1).otherwise(LEAST_TOKENS), F.lit(MOST_TOKENS))
        & made["parent_max_tokens"].between(LEAST_TOKENS, MOST_TOKENS)
        & made["child_max_tokens"].between(1, MOST_TOKENS)
        & (~nested | ((made["max_tokens"] == made["child_max_tokens"]) & (made["child_max_tokens"] < made["parent_max_tokens"])))
        & (made["overlap_tokens"] >= 0)
        & (made["overlap_tokens"] <= budget * 0.25)
    )
    return F.when(F.get_json_object(text, "$").isNotNull() & valid, made)
