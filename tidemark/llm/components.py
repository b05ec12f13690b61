"""Connected components by distributed union-find (alternating large-star and small-star steps), with SQL functions only.

Each step replaces the edges by others that join the same vertices; their number does not grow. It ends when every
vertex points straight at the least vertex of its component. No group is gathered: each vertex's least neighbour is an
aggregate, combined before the shuffle, and hot vertices meet it in a join whose partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, written


def _large(edges: DataFrame) -> DataFrame:
    """Every vertex's larger neighbours get an edge to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours get an edge to the least of them (edges point from larger to smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) pairs of one orderable type to (id, component): every vertex that has an edge, and the least vertex of its component.

    Null ends and loops are dropped; repeated and reversed pairs are harmless; no edges give no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        new = written(_small(_large(now)), "edges")
        before, state = state, _state(new)
        discard(now)
        now = new
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges and two checksums."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return r[0], r[1], r[2]
