"""Problem 3: records that differ only in white space, case, punctuation or field order, collapsed with counts.

Every record gets a canonical form (letters and digits only, upper and lower case as one; for records of named
fields, the fields in a fixed order) and a hash of it. Each part of the rows builds two Bloom filters, of hashes
seen once and seen again; merging parts ORs the filters and adds to "again" what both parts have once (the AND of
their filters can only be too large, never too small). Rows whose hash isn't in the merged "again" filter are
certainly alone and are emitted at once; only the others are shuffled and grouped exactly by a strong hash.

A filter consists of blocks, and all bits of a hash lie in one block, so tasks build and merge blocks independently:
each task sends only the blocks that it has rows of, compressed (about 7 bytes a row, whatever the number of tasks),
and each block is merged in one grouped task. What is broadcast for testing is at most MAX_BITS bits: beyond
ROWS_PER_SLICE rows the hash space is cut into slices. The keys (some 60 bytes a row) are then written once more, in a
folder for each slice, and each slice's files are tested against that slice's filter alone. So the bodies are read
once, and the keys three times, however many rows and slices there are.

Defined results: null and blank bodies are nobody's copies and stand alone; equal bodies count as copies;
doc_ids are compared as strings, and the smallest of a group is its first; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.common import materialize, read_table, spread_join, written

BITS_PER_ROW, HASHES, BLOCK_BITS, MAX_BITS = 12, 4, 1 << 18, 1 << 28
BLOCK_BYTES = BLOCK_BITS // 8
ROWS_PER_SLICE = MAX_BITS // BITS_PER_ROW
#: Rows that one task takes at least when filters are built or keys are written by slice.
ROWS_PER_TASK = 1 << 20


def bare(text: Column) -> Column:
    """Letters and digits only, case-folded (upper then lower; ß, whose capital is SS, as ss)."""
    return F.regexp_replace(F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")


def record_form(body: Column, file_type: Column) -> Column:
    """The canonical form of a record; null if nothing is left of it."""
    fields = F.split(F.regexp_replace(body, r"^\s*\{|\}\s*$", ""), r"""\s*(?:\||[\r\n]+|;|,\s*(?="[^"]*"\s*:))\s*""")
    named = F.transform(fields, lambda f: F.concat(bare(F.regexp_extract(f, r"^([^:=：＝]*)[:=：＝]", 1)), F.lit("\u0001"), bare(F.regexp_replace(f, r"^[^:=：＝]*[:=：＝]", ""))))
    ordered = F.array_join(F.array_sort(F.filter(named, lambda f: f != "\u0001")), "\u0002")
    form = F.when(F.coalesce(file_type, F.lit("")) == "csv", F.concat(F.lit("csv\u0003"), ordered)).otherwise(bare(body))
    return F.when(F.length(bare(body)) > 0, form)


def slice_of(h: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), h), F.lit(slices)).cast("int")


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each 64-bit hash, by its upper half."""
    return ((hashes.astype(np.int64).view(np.uint64) >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _positions(hashes: np.ndarray) -> np.ndarray:
    """HASHES bit positions of each 64-bit hash within its block, by double hashing."""
    h = hashes.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A block with the bits of the given hashes set."""
    flags = np.zeros(BLOCK_BITS, bool)
    flags[_positions(hashes).ravel()] = True
    return np.packbits(flags, bitorder="little")


def build_blocks(hashes: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, once, again) of the blocks that one part of the rows has hashes of."""
    if not len(hashes):
        return
    values, counts = np.unique(hashes, return_counts=True)
    block = _block_of(values, blocks)
    order = np.argsort(block, kind="stable")
    values, counts, block = values[order], counts[order], block[order]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    for begin, end in zip(starts, [*starts[1:], len(block)], strict=True):
        own = values[begin:end]
        yield int(block[begin]), _bits(own), _bits(own[counts[begin:end] > 1])


def merge(parts: Iterable[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Merged (once, again) of one block of several parts."""
    once, again = np.zeros(BLOCK_BYTES, np.uint8), np.zeros(BLOCK_BYTES, np.uint8)
    for other_once, other_again in parts:
        o = np.frombuffer(other_once, np.uint8)
        again |= np.frombuffer(other_again, np.uint8) | (once & o)
        once |= o
    return once, again


def has(again: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a merged filter (its blocks one after another)."""
    at = _block_of(hashes, len(again) // BLOCK_BYTES)[:, None] * BLOCK_BITS + _positions(hashes)
    return ((again[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def repeat_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The merged "again" blocks (slice, block, again: compressed) of a table (slice, h)."""
    pack = lambda x: pa.compress(x.tobytes(), codec="zstd", asbytes=True)
    unpack = lambda x: pa.decompress(x, decompressed_size=BLOCK_BYTES, codec="zstd", asbytes=True)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("slice", pa.int32()), ("h", pa.int64())]))  # 12 bytes a row of the part
        slices, hashes = table.column("slice").to_numpy(), table.column("h").to_numpy()
        for k in np.unique(slices):
            rows = [(int(k), block, pack(once), pack(again)) for block, once, again in build_blocks(hashes[slices == k], blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "block", "once", "again"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        _, again = merge((unpack(o), unpack(a)) for o, a in zip(rows["once"], rows["again"], strict=True))
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "block": rows["block"].iloc[:1], "again": [pack(again)]})

    built = keys.mapInArrow(build, "slice int, block int, once binary, again binary")
    return built.groupBy("slice", "block").applyInPandas(merged, "slice int, block int, again binary")


def seen_again(shared: Broadcast) -> Callable[[Column], Column]:
    """A test of 64-bit hashes against a broadcast filter."""

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(has(np.frombuffer(shared.value, np.uint8), h.to_numpy(np.int64)))

    return test


def split_repeats(keys: DataFrame, rows: int) -> DataFrame:
    """``keys`` (with a 64-bit ``h``, null for rows that can't be copies) plus ``maybe_copy``. ``rows`` is their number, or more."""
    spark = keys.sparkSession
    slices = max(1, math.ceil(rows / ROWS_PER_SLICE))
    blocks = max(1, math.ceil(rows / slices * BITS_PER_ROW / BLOCK_BITS))
    tasks = max(min(8, rows // 20_000 + 1), math.ceil(rows / ROWS_PER_TASK))
    able = keys.filter("h is not null").withColumn("slice", slice_of(F.col("h"), slices))
    if slices > 1:  # one folder for each slice, so that a slice's filter meets the files of that slice only
        able = written(able.coalesce(tasks), "slice")
    again = materialize(repeat_blocks(able.select("slice", "h").coalesce(tasks), blocks))
    done = [keys.filter("h is null").withColumn("maybe_copy", F.lit(False))]
    for k in range(slices):
        whole = np.zeros(blocks * BLOCK_BYTES, np.uint8)
        for row in again.filter(F.col("slice") == k).select("block", "again").toLocalIterator():  # MAX_BITS bits at most
            whole[row.block * BLOCK_BYTES : (row.block + 1) * BLOCK_BYTES] = np.frombuffer(pa.decompress(bytes(row.again), decompressed_size=BLOCK_BYTES, codec="zstd", asbytes=True), np.uint8)
        test = seen_again(spark.sparkContext.broadcast(whole.tobytes()))
        own = able.filter(F.col("slice") == k) if slices > 1 else able
        done.append(own.withColumn("maybe_copy", test("h")).select(*keys.columns, "maybe_copy"))
    return reduce(DataFrame.unionByName, done)


def copy_keys(df: DataFrame) -> DataFrame:
    """doc_id, ``h`` (64 bits of the canonical form) and ``form`` (its sha256), with ``maybe_copy``; written once."""
    form = record_form(F.col("body"), F.col("file_type"))
    made = df.select("doc_id", form.alias("f")).select("doc_id", F.when(F.col("f").isNotNull(), F.xxhash64("f")).alias("h"), F.unhex(F.sha2("f", 256)).alias("form"))
    return split_repeats(materialize(made), df.count())  # of a Parquet table, the count reads no column


def collapse(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(singletons, groups): ids that stand alone, and form, first_doc_id and n_copies of the exactly grouped rest."""
    alone = keys.filter(~F.col("maybe_copy")).select(F.col("doc_id").alias("first_doc_id"), F.lit(1).cast("bigint").alias("n_copies"))
    groups = keys.filter("maybe_copy").groupBy("form").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_copies"))
    return alone, groups


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, by its smallest doc_id, with the number of its copies."""
    alone, groups = collapse(copy_keys(read_table(spark, sf_dir, "catalog_documents")))
    return alone.unionByName(groups.select("first_doc_id", "n_copies"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = copy_keys(read_table(spark, sf_dir, "catalog_documents"))
    members = materialize(keys.filter("maybe_copy").select("doc_id", "form"))
    groups = members.groupBy("form").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    joined = spread_join(members, groups, "form", "n_copies", "doc_id")
    return joined.filter("doc_id <> first_doc_id").select("first_doc_id", F.col("doc_id").alias("copy_doc_id"))


#: The same in DuckDB, for bodies in which JSON records keep to the form "name": "value".
P3_BARE = "regexp_replace(replace(lower(upper({x})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
P3_SQL = f"""
with parts as (
  select doc_id, file_type, {P3_BARE.format(x='body')} as plain,
         list_filter(list_transform(
           regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(body, '^\\s*\\{{|\\}}\\s*$', '', 'g'), '",\\s*"', '";"', 'g'), '[\\r\\n]+', ';', 'g'), '\\s*[|;]\\s*'),
           lambda f: {P3_BARE.format(x="regexp_extract(f, '^([^:=：＝]*)[:=：＝]', 1)")} || chr(1) || {P3_BARE.format(x="regexp_replace(f, '^[^:=：＝]*[:=：＝]', '')")}), lambda f: f <> chr(1)) as fields
  from catalog_documents where body is not null),
forms as (select doc_id, case when file_type = 'csv' then 'csv' || chr(3) || array_to_string(list_sort(fields), chr(2)) else plain end as form from parts where plain <> ''),
firsts as (select form, min(doc_id) as first_doc_id from forms group by form)
select first_doc_id, doc_id as copy_doc_id from forms join firsts using (form) where doc_id <> first_doc_id
"""
