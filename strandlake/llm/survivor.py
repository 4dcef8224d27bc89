"""Problem 5: the best representative of each version group, elected field by field.

Every member votes for its value of every field; a vote weighs the member's source trust times a decay by the
time since the group's last real change. Fields are unpivoted to rows, votes are summed for each normalised
value, ``max_by`` takes the winner and its newest spelling, and the winners are pivoted back to one row.

Defined results: rows without a version group are left out (they are states of nothing else); null and blank
values don't vote; a field without votes is null; a group of repeated rows counts each row; a group without a
member of possible time still gets a record, with a null ``survivor_doc_id``; ties go to the larger value, so
the result is the same in every run. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import read_table, spread_join

#: Fields elected by vote, with the trust of a record that isn't fully parsed lowered for texts.
FIELDS = ("title", "body", "summary", "source", "project", "file_type", "language", "visibility", "space_id", "status", "source_path", "file_name")
#: Half-life of a vote in days, and trust by origin of the record; others have DEFAULT_TRUST.
HALF_LIFE_DAYS = 30.0
TRUST = {"manual_upload": 1.0, "repo_mirror": 0.9, "course_backup": 0.8, "drive_sync": 0.8, "phone_sync": 0.6}
DEFAULT_TRUST = 0.7
#: Forms in which a time without a zone is written.
LOCAL_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "dd MMM yyyy", "yyyy-MM-dd HH:mm", "yyyyMMdd'T'HHmmss")


def readable_time(value: Column) -> Column:
    """A stored time as UTC seconds since 1970 (double); null if it can't be read.

    ISO times keep their zone, times without one and dates are UTC, and a bare number counts seconds from 1970
    (milliseconds from twelve digits on).
    """
    text = F.trim(value)
    number = text.rlike(r"^\d{1,17}(\.\d+)?$") & ~text.rlike(r"^\d{8}T")
    count = text.try_cast("double")
    digits = F.length(F.regexp_extract(text, r"^(\d+)", 1))
    epoch = F.when(digits >= 18, count / 1e9).when(digits >= 15, count / 1e6).when(digits >= 12, count / 1e3).otherwise(count)
    zoned = text.rlike(r"[T ]\d{1,2}:\d{2}.*([zZ]|[+-]\d{2}:?\d{2})$")
    # the zone is read as an offset by hand, so that the session's zone plays no part
    sign = F.when(F.regexp_extract(text, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    offset = F.when(
        text.rlike(r"[+-]\d{2}:?\d{2}$"),
        sign * (F.regexp_extract(text, r"[+-](\d{2}):?\d{2}$", 1).try_cast("int") * 3600 + F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int") * 60),
    ).otherwise(0)
    bare = F.when(zoned, F.regexp_replace(text, r"\s*([zZ]|[+-]\d{2}:?\d{2})$", "")).otherwise(text)
    fraction = F.coalesce(F.regexp_extract(bare, r":\d{2}(\.\d+)$", 1).try_cast("double"), F.lit(0.0))
    whole = F.regexp_replace(bare, r"(:\d{2})\.\d+$", "$1")
    local = F.coalesce(*(F.try_to_timestamp(F.concat(whole, F.lit("+00:00")), F.lit(form + "xxx")) for form in LOCAL_FORMS))
    return F.when(number, epoch).otherwise(F.unix_micros(local) / 1e6 + fraction - F.when(zoned, offset).otherwise(0))


def with_real_time(df: DataFrame) -> DataFrame:
    """``df`` with ``real_s``: modified_at in UTC seconds if it is a possible time (since 2000, not after updated_at)."""
    seconds = readable_time(F.col("modified_at"))
    least = F.lit(946684800.0)
    return df.withColumn("real_s", F.when((seconds >= least) & (seconds <= readable_time(F.col("updated_at"))), seconds))


def elect_survivors(df: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "version_group_id") -> DataFrame:
    """One surviving record for each group: the elected fields, the member really modified last, and the size."""
    filled = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}\p{C}]+", "")) > 0
    members = with_real_time(df.filter(F.col(group).isNotNull()).select(group, "doc_id", "modified_at", "updated_at", "is_latest", "parse_status", *fields))
    members = members.withColumn("real_s", F.when(filled(F.col("body")), F.col("real_s")))
    trust = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in TRUST.items() for x in pair)), F.col("source")), F.lit(DEFAULT_TRUST))
    trust = trust * F.when(F.col("parse_status") == "ready", 1.0).otherwise(0.5)
    bounds = members.groupBy(group).agg(
        F.max("real_s").alias("last_s"),
        F.sum(F.when(F.col("is_latest") == 1, 1).otherwise(0)).alias("marked_latest"),
        F.max(F.when(F.col("is_latest") == 1, F.col("doc_id"))).alias("marked_doc_id"),
        F.count(F.lit(1)).alias("members"),
    )
    votes = spread_join(members, bounds.select(group, "last_s", F.col("members").alias("group_rows")), group, "group_rows", "doc_id")
    decay = F.pow(F.lit(0.5), (F.col("last_s") - F.col("real_s")) / 86400.0 / HALF_LIFE_DAYS)
    # the record's own id is elected by recency alone, and only among members of possible time
    ballots = [F.struct(F.lit("doc_id").alias("field"), F.when(decay.isNotNull(), F.col("doc_id")).alias("value"), decay.alias("weight"))]
    ballots += [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), (trust * F.coalesce(decay, F.lit(0.01))).alias("weight")) for f in fields]
    long = votes.select(group, F.coalesce("real_s", F.lit(0.0)).alias("real_s"), F.explode(F.array(*ballots)).alias("v")).select(group, "real_s", "v.*")
    long = long.filter(filled(F.col("value")))
    # long texts are tallied by the hash of their normalised form; the newest spelling of each form is kept
    normal = F.trim(F.lower(F.regexp_replace("value", r"[\s\p{Z}]+", " ")))
    form = F.when(F.col("field") == "doc_id", F.col("value")).otherwise(F.sha2(normal, 256))
    tally = long.groupBy(group, "field", form.alias("form")).agg(F.sum("weight").alias("votes"), F.max_by("value", F.struct("real_s", "value")).alias("value"), F.max("real_s").alias("newest_s"))
    winners = tally.groupBy(group).pivot("field", ["doc_id", *fields]).agg(F.max_by("value", F.struct(F.round("votes", 9), "newest_s", "value")))
    winners = winners.withColumnRenamed("doc_id", "survivor_doc_id")
    times = F.timestamp_micros((F.col("last_s") * 1e6).cast("long")).alias("modified_at")
    return bounds.join(winners, group, "left").select(group, "survivor_doc_id", "members", "marked_latest", "marked_doc_id", times, *fields)


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elect_survivors(read_table(spark, sf_dir, "catalog_documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member really modified last of each group in which is_latest = 1 doesn't mark exactly that one."""
    elected = p5_survivors(spark, sf_dir).filter(F.col("survivor_doc_id").isNotNull())
    right = (F.col("marked_latest") == 1) & (F.col("marked_doc_id") == F.col("survivor_doc_id"))
    return elected.filter(~F.coalesce(right, F.lit(False))).select("version_group_id", F.col("survivor_doc_id").alias("doc_id"))
