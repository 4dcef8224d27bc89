"""Problem 7: filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

How well texts fit depends on their sizes alone, and a size is a whole number up to the capacity. So the plan is
made from the counts of each size (at most ``capacity`` of them, however many texts there are), one task for each
budget, and is itself a list of container patterns with multiplicities. The texts are then numbered within their
size, in parallel, and look their container up in the slots of their size.

The plan first reduces the instance by the dominance rules of Martello and Toth: a largest size j is joined for
good with
* nothing, if no other item fits beside it;
* the largest k that fits beside it, if no third item fits, or if j + k fill the container, or if no pair that
  fits beside j (four items being too many) is longer than k;
* k and the largest b that still fits, if four items are too many and no pair beside j has a smaller member over b.
Each of these sets can replace any other set with j without needing more containers. What the rules leave goes
best-fit, largest size first.

A text longer than the capacity is cut into full pieces, each a container of its own, and a rest that is packed
like a text; shorter texts are never cut.

Defined results: null and empty texts have no tokens and take no room; their container is null. Repeated rows are
packed as often as they occur; a null doc_id is packed like any other. An empty table gives no rows. A budget
whose tokenizer is null or whose capacity isn't positive gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.common import materialize, read_table, salt
from strandlake.llm.encode import encoder_udf

#: Parts, at least, into which the rows of one size are spread while they are numbered, and rows that a part may have.
LEAST_PARTS, ROWS_PER_PART = 32, 100_000
Pattern = tuple[tuple[int, ...], int]


def _take(counts: dict[int, int], sizes: list[int], used: tuple[int, ...], times: int) -> None:
    for size in used:
        counts[size] -= times
    for size in set(used):
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect_left(sizes, size))


def _times(counts: dict[int, int], used: tuple[int, ...]) -> int:
    return min(counts[s] // used.count(s) for s in set(used))


def _largest(counts: dict[int, int], sizes: list[int], room: int, held: tuple[int, ...]) -> int | None:
    """The largest size that fits into ``room`` while ``held`` are taken."""
    k = bisect_right(sizes, room) - 1
    while k >= 0 and counts[sizes[k]] <= held.count(sizes[k]):
        k -= 1
    return sizes[k] if k >= 0 else None


def _smallest(counts: dict[int, int], sizes: list[int], number: int, held: tuple[int, ...]) -> int | None:
    """Sum of the ``number`` smallest items beside ``held``; None if there are fewer."""
    total, left = 0, number
    for size in sizes:
        free = min(left, counts[size] - held.count(size))
        if free > 0:
            total, left = total + free * size, left - free
        if not left:
            return total
    return None


def _longest_pair(counts: dict[int, int], sizes: list[int], room: int, held: tuple[int, ...]) -> int:
    """The largest sum of two items within ``room`` beside ``held``; 0 if no pair fits."""
    free = np.array([s for s in sizes if s < room and counts[s] > held.count(s)], dtype=np.int64)
    if not len(free):
        return 0
    partner = np.searchsorted(free, room - free, side="right") - 1
    single = np.array([counts[int(s)] - held.count(int(s)) < 2 for s in free])
    partner = np.where((partner == np.arange(len(free))) & single, partner - 1, partner)
    fits = (partner >= 0) & (partner <= np.arange(len(free)))
    high = (partner > np.arange(len(free))) & (partner >= 0)
    sums = np.concatenate([(free + free[partner])[fits | high], [0]])
    return int(sums.max())


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fix sets that dominate all others, largest sizes first; ``counts`` keeps what is left."""
    sizes, fixed = sorted(counts), []
    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room, one = capacity - j, (j,)
            k = _largest(counts, sizes, room, one)
            if k is None:
                chosen = one
            else:
                pair, third = (j, k), _smallest(counts, sizes, 2, one)
                if j + k == capacity or third is None or third > room:
                    chosen = pair
                else:
                    fourth = _smallest(counts, sizes, 3, one)
                    if fourth is not None and fourth <= room:
                        break
                    b = _largest(counts, sizes, room - k, pair)
                    if _longest_pair(counts, sizes, room, one) <= k:
                        chosen = pair
                    elif b is not None and (_largest(counts, sizes, room // 2, one) or 0) <= b:
                        chosen = (*pair, b)
                    else:
                        break
            times = _times(counts, chosen)
            if k is None:
                times = counts[j]
            fixed.append((chosen, times))
            _take(counts, sizes, chosen, times)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, largest first, on whole classes of equal items and equally filled containers."""
    open_: dict[int, list[Pattern]] = defaultdict(list)
    residuals: list[int] = []

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if times:
            if not open_[room]:
                insort(residuals, room)
            open_[room].append((items, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(residuals, size)
            if k < len(residuals):
                room = residuals[k]
                items, times = open_[room].pop()
                if not open_[room]:
                    residuals.pop(k)
            else:
                room, items, times = capacity, (), left
            each = room // size
            full = min(times, left // each)
            put(room - each * size, items + (size,) * each, full)
            left -= full * each
            rest = left if full < times else 0
            if rest:
                put(room - rest * size, items + (size,) * rest, 1)
                left = 0
            if items:
                put(room, items, times - full - bool(rest))
    return [p for patterns in open_.values() for p in patterns]


def plan_patterns(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Container patterns (sizes, number of such containers) for ``counts`` items of each size up to ``capacity``."""
    left = dict(counts)
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _slots(rows: pd.DataFrame) -> pd.DataFrame:
    """The slots of each size: items begin..end-1 of a size go to container base + (item - begin) // each."""
    capacity = int(rows["capacity_tokens"].iloc[0])
    counts = {int(n): int(c) for n, c in zip(rows["n_tokens"], rows["items"], strict=True)}
    base = 0
    placed: dict[int, int] = defaultdict(int)
    out = []
    for items, times in plan_patterns(counts, capacity):
        for size in sorted(set(items)):
            each = items.count(size)
            out.append((size, placed[size], placed[size] + each * times, base, each))
            placed[size] += each * times
        base += times
    made = pd.DataFrame(out, columns=["n_tokens", "begin", "end", "base", "each"])
    made.insert(0, "budget_id", rows["budget_id"].iloc[0])
    return made


def measure_texts(documents: DataFrame, tokenizers: list[str], folder: str | None = None) -> DataFrame:
    """doc_id, tokenizer and n_tokens of every text, one row for each of the named tokenizers."""
    counted = documents.select("doc_id", *(encoder_udf(documents.sparkSession, name, folder, lengths=True)(F.col("text")).alias(f"n{k}") for k, name in enumerate(tokenizers)))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.col(f"n{k}").cast("bigint").alias("n")) for k, name in enumerate(tokenizers))))
    return counted.select("doc_id", each.alias("m")).select("doc_id", "m.*")


def pack(measured: DataFrame, budgets: DataFrame) -> DataFrame:
    """Containers for all measured texts of every budget: one row for each piece of a text."""
    valid = budgets.filter("capacity_tokens > 0").select("budget_id", "tokenizer", "capacity_tokens")
    sized = measured.join(valid, "tokenizer")
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity_tokens")) - 1, F.lit(0))
    pieces = sized.select("budget_id", "capacity_tokens", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity_tokens")
    pieces = pieces.select("budget_id", "capacity_tokens", "doc_id", "piece_no", start.alias("start_token"), F.least("capacity_tokens", F.col("n") - start).alias("n_tokens"))
    pieces = materialize(pieces)
    parts = max(LEAST_PARTS, -(-pieces.count() // ROWS_PER_PART))  # were all pieces of one size
    pieces = pieces.withColumn("part", salt("doc_id", "piece_no", salts=parts))

    counted = pieces.filter("n_tokens > 0").groupBy("budget_id", "capacity_tokens", "n_tokens", "part").agg(F.count(F.lit(1)).alias("items"))
    counted = materialize(counted)
    before = counted.withColumn("before", F.sum("items").over(W.partitionBy("budget_id", "n_tokens").orderBy("part")) - F.col("items"))
    slots = counted.groupBy("budget_id", "capacity_tokens", "n_tokens").agg(F.sum("items").alias("items"))
    slots = slots.groupBy("budget_id").applyInPandas(_slots, "budget_id bigint, n_tokens bigint, begin bigint, end bigint, base bigint, each bigint")
    slots = slots.groupBy("budget_id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "base", "each"))).alias("slots"))

    # numbering restarts in each part of a size, so that the rows of a common size don't meet in one task
    number = F.row_number().over(W.partitionBy("budget_id", "n_tokens", "part").orderBy("doc_id", "piece_no")) - 1
    numbered = pieces.filter("n_tokens > 0").withColumn("number", number.cast("bigint"))
    # each part looks its items up in the slots that its own range of items meets
    meets = lambda s: (s["begin"] < F.col("before") + F.col("items")) & (F.col("before") < s["end"])
    places = before.select("budget_id", "n_tokens", "part", "before", "items").join(slots, ["budget_id", "n_tokens"]).withColumn("slots", F.filter("slots", meets)).drop("items")
    placed = numbered.join(places, ["budget_id", "n_tokens", "part"]).withColumn("item", F.col("number") + F.col("before"))
    slot = F.element_at(F.filter("slots", lambda s: (s["begin"] <= F.col("item")) & (F.col("item") < s["end"])), 1)
    placed = placed.withColumn("slot", slot).withColumn("container_id", F.expr("slot.base + (item - slot.begin) div slot.each"))
    columns = ("budget_id", "container_id", "doc_id", "piece_no", "start_token", "n_tokens")
    return placed.select(*columns).unionByName(pieces.filter("n_tokens <= 0").withColumn("container_id", F.lit(None).cast("bigint")).select(*columns))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = read_table(spark, sf_dir, "prompt_budgets")
    tokenizers = sorted(r[0] for r in budgets.select("tokenizer").filter("tokenizer is not null").distinct().collect())
    return pack(measure_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizers), budgets)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each budget are."""
    containers = p7_containers(spark, sf_dir).filter("container_id is not null").groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    total = containers.groupBy("budget_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    budgets = read_table(spark, sf_dir, "prompt_budgets").select("budget_id", "capacity_tokens")
    return total.join(budgets, "budget_id").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
