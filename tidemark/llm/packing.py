"""Packing documents into sequences by cutting-stock column generation.

A document longer than a sequence gives full pieces and one rest; every piece has a class, its length in units of
``GRAIN`` tokens, rounded up. The histogram of classes, a few hundred numbers whatever the corpus, is all that the
driver sees. There a linear program says how often each pattern (a multiset of classes that fits a sequence) is used:
the simplex method starts from one pattern per class, and a knapsack dynamic program over the dual prices finds each next
pattern, until none pays. Rounded-down patterns take pieces by their rank within their class; what remains, less than
one sequence per pattern, is packed by best fit. Ranks need no global sort: a piece has its rank among those of its
class and partition, and partitions have offsets.

Defined cases: a null text counts as empty, and an empty text is the end id alone; a document of any length is cut into
as many pieces as it needs; repeated rows are packed each; an empty table gives an empty result; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import conf, written
from tidemark.llm.words import KEPT_PARTS, batches, encoder

GRAIN = 8
PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, cls int, part int, rank bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT_PARTS) -> DataFrame:
    """Encode and cut: one written row per piece with its ids (``<u4`` bytes), class, and rank within (partition, class)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, ranks = TaskContext.get().partitionId(), encoder(tokenizer, False, kept), np.zeros(capacity // GRAIN + 2, np.int64)
        for names, texts in batches(rows):
            out: list[list] = [[] for _ in range(8)]
            for name, data in zip(names, enc.encode(texts), strict=True):
                data += end
                n = len(data) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    cls = -(-length // GRAIN)
                    for column, value in zip(out, (name, start, length, data[4 * start : 4 * (start + length)], n, cls, part, int(ranks[cls])), strict=True):
                        column.append(value)
                    ranks[cls] += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "cls", "part", "rank"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with conf(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        return written(rows.mapInArrow(cut, PIECE), "pieces", "snappy")


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: prices[c] for each piece of class c + 1 (units), within ``capacity`` units."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        m = min(room, len(prices))
        values = prices[:m] + best[room - m : room][::-1]
        k = int(values.argmax())
        best[room], took[room] = (values[k], k + 1) if values[k] > best[room - 1] else (best[room - 1], 0)
    pattern, room = np.zeros(len(prices), np.int64), capacity
    while room > 0:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses): the linear program min sum(uses) with patterns covering the demand, by column generation.

    demand[c]: pieces of class c + 1. Ends when no pattern pays, or when Farley's bound says that less than ``gap`` is
    left to gain.
    """
    rows = np.flatnonzero(demand)
    need, units = demand[rows].astype(float), rows + 1
    basis = np.diag(capacity // units).astype(np.int64)  # column p: pieces of each class in pattern p
    inverse, uses = np.diag(1.0 / (capacity // units)), need / (capacity // units)
    prices, at = np.zeros(capacity), rows
    for _ in range(rounds):
        dual = inverse.sum(0)
        prices[:] = 0
        prices[at] = np.maximum(dual, 0)
        value, pattern = knapsack(prices, capacity)
        if value <= 1 + 1e-9 or uses.sum() * (1 - 1 / value) <= gap * uses.sum():
            break
        column = pattern[at].astype(float)
        direction = inverse @ column
        ok = direction > 1e-10
        if not ok.any():
            break
        ratio = np.full(len(rows), np.inf)
        ratio[ok] = uses[ok] / direction[ok]
        out = int(ratio.argmin())
        step = ratio[out]
        uses = np.maximum(uses - step * direction, 0)
        uses[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[:, out] = pattern[at]
    patterns = np.zeros((len(rows), capacity), np.int64)
    patterns[:, at] = basis.T
    return patterns, uses


def plan(demand: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks go where: (class, first rank, ranks, pieces per sequence, first sequence, first slot) for each class of each pattern in use."""
    left, at, deals, sequence = demand.astype(np.int64).copy(), np.zeros(len(demand), np.int64), [], 0

    def deal(pattern: np.ndarray, copies: int) -> None:
        nonlocal sequence
        slot = 0
        for c in np.flatnonzero(pattern)[::-1]:
            a = int(pattern[c])
            deals.append((int(c) + 1, int(at[c]), a * copies, a, sequence, slot))
            at[c] += a * copies
            left[c] -= a * copies
            slot += a
        sequence += copies

    if demand.any():
        patterns, uses = solve(demand, capacity)
        for p in np.argsort(-uses):
            used = np.flatnonzero(patterns[p])
            copies = min(int(uses[p] + 1e-7), *(int(left[c] // patterns[p][c]) for c in used))
            if copies > 0:
                deal(patterns[p], copies)
    bins: list[tuple[int, np.ndarray]] = []  # best fit, largest first; few pieces remain
    for c in np.flatnonzero(left)[::-1]:
        for _ in range(int(left[c])):
            fits = [(room, i) for i, (room, _) in enumerate(bins) if room >= c + 1]
            if fits:
                room, i = min(fits)
                bins[i][1][c] += 1
                bins[i] = (room - c - 1, bins[i][1])
            else:
                pattern = np.zeros(len(demand), np.int64)
                pattern[c] = 1
                bins.append((capacity - c - 1, pattern))
    for _, pattern in bins:
        deal(pattern, 1)
    return deals


def assign(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place pieces: all columns of ``cut`` but cls, part and rank, with sequence_id and offset.

    The lookups are small: the plan has at most (classes + 1) squared rows; partition offsets, one row for each class
    and partition, are joined as they are.
    """
    spark, units = cut.sparkSession, capacity // GRAIN
    counts = cut.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    demand = np.zeros(units, np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        demand[r["cls"] - 1] = r["n"]
    schema = "p_cls int, p_first bigint, p_n bigint, p_each bigint, p_sequence bigint, p_slot bigint"
    deals = F.broadcast(spark.createDataFrame(plan(demand, units), schema))
    ranked = cut.join(offsets, ["part", "cls"]).withColumn("at", F.col("ahead") + F.col("rank"))
    dealt = ranked.join(deals, (F.col("cls") == F.col("p_cls")) & (F.col("at") >= F.col("p_first")) & (F.col("at") < F.col("p_first") + F.col("p_n")))
    k = F.col("at") - F.col("p_first")
    dealt = dealt.withColumn("sequence_id", F.col("p_sequence") + F.floor(k / F.col("p_each"))).withColumn("slot", F.col("p_slot") + k % F.col("p_each"))
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return dealt.select(*(c for c in cut.columns if c not in ("cls", "part", "rank")), "sequence_id", "offset")


def sequences(placed: DataFrame, pad_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per sequence: sequence_id, n_pieces, n_tokens, ids (``<u4`` bytes, padded to ``capacity`` unless their number is a power of two)."""
    by = placed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")
    )
    pad = np.array([pad_id], "<u4").tobytes().hex()
    whole = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    fill = F.unhex(F.repeat(F.lit(pad), F.when(whole, 0).otherwise(capacity - F.col("n_tokens")).cast("int")))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda s, x: F.concat(s, x["ids"]))
    return by.select("sequence_id", "n_pieces", "n_tokens", F.concat(joined, fill).alias("ids"))
