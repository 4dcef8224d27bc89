"""Helpers that every operator uses: reading tables, cutting lineage, splitting hot groups."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, a Parquet file or folder below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``.

    Where none is set, a local session (tests, one machine) gets a temporary folder; on a cluster that is an error,
    since executors share no machine-local folder.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that it is computed once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder, in a folder for each value of ``by``, and read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt(*keys: str | Column, salts: int) -> Column:
    """A stable salt in [0, salts) from the given columns."""
    return F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, row_id: str, *, hot: int = 100_000, salts: int = 64, how: str = "inner") -> DataFrame:
    """Join rows to their group's single row, where a few groups may hold a large share of all rows.

    ``groups`` has one row for each ``key`` and the number of its rows in ``size``. Groups of more than ``hot``
    rows are repeated ``salts`` times, and their rows go to one of the copies by ``row_id``. A row can't know
    whether its group is hot, so ``rows`` carry both salts only through the group table: the hot keys (at most
    rows/``hot`` of them) mark the rows first, by a join that Spark's adaptive execution broadcasts when small.
    """
    hot_keys = groups.filter(F.col(size) > hot).select(key, F.lit(True).alias("__hot"))
    marked = rows.join(hot_keys, key, "left").withColumn("__salt", F.when(F.col("__hot"), salt(row_id, salts=salts)).otherwise(F.lit(0))).drop("__hot")
    copies = F.when(F.col(size) > hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = groups.withColumn("__salt", F.explode(copies))
    return marked.join(spread, [key, "__salt"], how).drop("__salt")


def spread_pairs(rows: DataFrame, key: str, row_id: str, condition: str, *, hot: int = 2_000, salts: int = 64) -> DataFrame:
    """Pairs (a, b) of ``rows`` with equal ``key`` that meet ``condition`` (an expression on a.* and b.*).

    A key of more than ``hot`` rows is split: its a rows go to one of ``salts`` parts by ``row_id``, and its b rows to
    all of them, so that no task holds all pairs of a large key. Columns come back as structs ``a`` and ``b``.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > hot).select(key, F.lit(salts).alias("__parts"))
    marked = rows.join(sizes, key, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    whole = F.struct(*(F.col(c) for c in rows.columns))
    left = marked.select(F.col(key).alias("__key"), F.pmod(F.xxhash64(row_id), F.col("__parts")).cast("int").alias("__part"), whole.alias("a"))
    right = marked.select(F.col(key).alias("__key"), F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), whole.alias("b"))
    return left.join(right, ["__key", "__part"]).filter(condition).select("a", "b")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer file; the folder is a parameter, or ``TOKENIZER_DIR``, or the installed package."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def first_by_hash(df: DataFrame, key: str, most: int, count: int | None = None) -> DataFrame:
    """A bounded, repeatable sample: about the first ``most`` rows, and no more, by a hash of ``key``.

    The rows are counted first (unless ``count``, their number or more, is known) and cut by a bound on the hash, so that every task sends the driver only its part of
    the sample, and not ``most`` rows of its own.
    """
    number, count = F.xxhash64(key), df.count() if count is None else count
    bound = int(min(1.0, (1.2 * most + 50) / max(1, count)) * 2**64) - 2**63
    return df.filter(number <= F.lit(min(bound, 2**63 - 1))).orderBy(number, key).limit(most)
