"""Copies, survivors, encoding, packing: against brute force, with nulls, empties, ties, repeats and hot groups."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.common import tokenizer_path
from strandlake.llm import encode, formatdup, pack, survivor
from strandlake.llm.queries import oracle_sql, queries
from tests.compare import rows, tables


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, small, name):
    made = queries()[name](spark, small).toPandas()
    expected = tables(small).sql(oracle_sql()[name]).df()
    columns = sorted(made.columns)
    assert rows(made, columns) == rows(expected, columns)


def test_copies_of_a_fixture(spark):
    data = [
        ("a", "Hello, World 1", "txt"), ("b", "hello world-1!", "md"), ("c", "hello world 2", "txt"), ("d", None, "txt"), ("e", " \n", "txt"), ("f", None, None),
        ("g", "name: X | size: 3", "csv"), ("h", "SIZE = 3; NAME = x", "csv"), ("i", '{"size": "3", "name": "X"}', "csv"), ("j", "name: 3 | size: X", "csv"), ("k", "STRASSE", "txt"), ("l", "straße", "txt"),
    ]
    alone, groups = formatdup.collapse(formatdup.copy_keys(spark.createDataFrame(data, "doc_id string, body string, file_type string")))
    counts = Counter({r.first_doc_id: r.n_copies for r in alone.unionByName(groups.select("first_doc_id", "n_copies")).collect()})
    null_groups = {k: v for k, v in counts.items() if k in "def"}
    assert {k: v for k, v in counts.items() if k not in "def"} == {"a": 2, "c": 1, "g": 3, "j": 1, "k": 2} and null_groups == {"d": 1, "e": 1, "f": 1}


def test_slices_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr(formatdup, "ROWS_PER_SLICE", 90)
    df = spark.range(1000).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot!").otherwise(F.concat(F.lit("text "), F.floor(F.col("id") / 2))).alias("body"), F.lit("txt").alias("file_type"))
    keys = formatdup.copy_keys(df)
    alone, groups = formatdup.collapse(keys)
    made = sorted(r.n_copies for r in alone.unionByName(groups.select("first_doc_id", "n_copies")).collect())
    expected = Counter("hot" if k % 3 == 0 else f"text{k // 2}" for k in range(1000))
    assert made == sorted(expected.values())


def test_many_slices_read_every_key_once(spark, monkeypatch):
    scanned = []
    test = formatdup.seen_again
    monkeypatch.setattr(formatdup, "ROWS_PER_SLICE", 100)
    monkeypatch.setattr(formatdup, "seen_again", lambda shared: scanned.append(len(shared.value)) or test(shared))
    keys = spark.range(2000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), F.col("id").alias("form"))
    made = formatdup.split_repeats(keys, 2000)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # twenty slices, one filter and one scan of its own folder each, none of the others' rows
    assert len(scanned) == 20 and plan.count("PartitionFilters: [isnotnull(slice") == 20
    assert made.count() == 2000 and made.filter("maybe_copy").count() < 100


@given(st.lists(st.lists(st.integers(0, 50), max_size=40), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_merged_filters_miss_no_repeat(parts):
    blocks, made = 3, {}
    for part in parts:
        for block, once, again in formatdup.build_blocks(np.array(part, dtype=np.int64) * 7919 << 30, blocks):
            made.setdefault(block, []).append((once.tobytes(), again.tobytes()))
    whole = np.concatenate([formatdup.merge(made.get(k, []))[1] for k in range(blocks)])
    repeated = [v for v, n in Counter(v for part in parts for v in part).items() if n > 1]
    assert formatdup.has(whole, np.array(repeated, dtype=np.int64) * 7919 << 30).all()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, body string, file_type string")
    alone, groups = formatdup.collapse(formatdup.copy_keys(empty))
    assert alone.count() == groups.count() == 0


def test_readable_times(spark):
    forms = {"2024-01-15T10:00:00+08:00": 1705284000, "2024-01-15 02:00:00": 1705284000, "2024/01/15 02:00:00": 1705284000, "15 Jan 2024 02:00:00": 1705284000, "1705284000": 1705284000, "1705284000000": 1705284000, "2024-01-15": 1705276800, "2024-01-15T02:00:00Z": 1705284000, "2024-01-15T02:00:00.500000+00:00": 1705284000.5, "n/a": None, "": None, "2024-13-45": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(forms)], "k int, t string")
    got = [r.s for r in df.select("k", survivor.readable_time(F.col("t")).alias("s")).orderBy("k").collect()]
    assert got == [None if v is None else float(v) for v in forms.values()]


def test_survivors_of_a_fixture(spark):
    columns = ["doc_id", "version_group_id", "modified_at", "updated_at", "is_latest", "parse_status", *survivor.FIELDS]

    def member(doc_id, group, at, latest, **fields):
        base = dict.fromkeys(survivor.FIELDS) | {"source": "manual_upload", "body": "text"} | fields
        return (doc_id, group, at, "2025-06-01T00:00:00+00:00", latest, "ready", *(base[f] for f in survivor.FIELDS))

    data = [
        member("a", "g", "2025-01-01", 1, title="Old", project="P"), member("b", "g", "2025-05-01", 0, title="New "), member("c", "g", "2026-01-01", 0, title="Future"),
        member("d", "g", "1970-01-01T00:00:00Z", 0, title="Zero"), member("e", "g", "2025-05-20", 0, body=" ", title="Blank"), member("f", "h", None, 1), member("g", None, "2025-01-01", 1),
    ]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'int' if c == 'is_latest' else 'string'}" for c in columns))
    got = {r.version_group_id: r for r in survivor.elect_survivors(df).collect()}
    assert set(got) == {"g", "h"} and got["g"].survivor_doc_id == "b" and got["g"].title == "New " and got["g"].project == "P" and got["g"].members == 5
    assert got["h"].survivor_doc_id is None and got["h"].title is None and got["h"].body == "text"
    assert survivor.elect_survivors(df.limit(0)).count() == 0


def test_encoding_equals_the_public_library(spark, small):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in queries()["p6_ids"](spark, small).collect()}
    assert got == dict(zip(texts, (e.ids for e in whole.encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))


@given(st.text(max_size=200) | st.text(alphabet="aé 中\n<|endoftext>'1", max_size=120))
@settings(max_examples=150, deadline=None)
def test_forced_boundaries_change_nothing(text):
    import tiktoken

    global _PAIR
    if "_PAIR" not in globals():
        own = encode.ForcedBoundaryEncoder(open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb").read())
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb"))}
        _PAIR = own, tiktoken.Encoding("whole", pat_str=encode.PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, whole = _PAIR
    assert own.encode(text) == whole.encode_ordinary(text)


def test_encoding_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|>"), (4, "a" * 100_000), (5, "中" * 20_000), (3, "<|endoftext|>")], "doc_id int, text string")
    got = encode.encode_texts(df.withColumn("pieces", F.lit(1))).collect()
    by = {r.doc_id: r.ids for r in got}
    assert by[1] == by[2] == [] and len(by[3]) > 1 and by[4] and by[5] and len(got) == 6 and got[0].pieces == 1
    assert encode.encode_texts(df.limit(0)).count() == 0


def best_fit_decreasing(items, capacity):
    bins = []
    for size in sorted(items, reverse=True):
        rooms = [k for k, r in enumerate(bins) if r >= size]
        if rooms:
            bins[min(rooms, key=lambda k: bins[k])] -= size
        else:
            bins.append(capacity - size)
    return len(bins)


@given(st.integers(5, 60), st.data())
@settings(max_examples=120, deadline=None)
def test_plans_hold_every_item_once(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), max_size=40))
    patterns = pack.plan_patterns(Counter(items), capacity)
    held = Counter()
    for sizes, times in patterns:
        assert sum(sizes) <= capacity and times > 0
        for size in sizes:
            held[size] += times
    assert held == Counter(items)
    assert sum(t for _, t in patterns) <= best_fit_decreasing(items, capacity) + 1


def optimum(items, capacity, bins=()):
    if not items:
        return len(bins)
    size, rest = items[0], items[1:]
    tried = {r for r in bins if r >= size}
    best = [optimum(rest, capacity, tuple(sorted((*(b for k, b in enumerate(bins) if k != bins.index(r)), r - size)))) for r in tried]
    return min([*best, optimum(rest, capacity, tuple(sorted((*bins, capacity - size))))])


def test_dominance_loses_no_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice((10, 15, 20))
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 7))), reverse=True)
        left = dict(Counter(items))
        fixed = pack.reduce_by_dominance(left, capacity)
        rest = tuple(sorted((s for s, n in left.items() for _ in range(n)), reverse=True))
        assert sum(t for _, t in fixed) + optimum(rest, capacity) == optimum(tuple(items), capacity), items


def test_packing_table(spark):
    measured = spark.createDataFrame([(k, "t", 3) for k in range(50)] + [(100, "t", 25), (101, "t", 0), (102, None, 4), (103, "t", 10)], "doc_id bigint, tokenizer string, n bigint")
    budgets = spark.createDataFrame([(1, "t", 10), (2, "t", 0), (3, None, 10)], "budget_id bigint, tokenizer string, capacity_tokens int")
    got = pack.pack(measured, budgets).toPandas()
    assert set(got.budget_id) == {1} and len(got) == 50 + 3 + 1 + 1
    assert got.groupby("container_id").n_tokens.sum().max() <= 10
    assert list(got[got.doc_id == 100].sort_values("piece_no").n_tokens) == [10, 10, 5] and got.n_tokens.sum() == 185
    assert got.container_id.nunique() <= 21 and got.groupby(["doc_id", "piece_no"]).size().max() == 1
    assert pack.pack(measured.limit(0), budgets).count() == 0
