"""URL filters: path rules, and exact membership of a key list by a cascade of Bloom filters.

Level 1 encodes the listed keys. Level 2 encodes the unlisted keys of the corpus's complete key universe that level 1
lets through, level 3 the listed keys that level 2 lets through, and so on until a level lets nothing wrong through. A
key of the universe is listed exactly if the first level that rejects it has an even number (or, where none rejects it,
if the number of levels is odd). Probing needs no join: each level is a scalar subquery of one row, a bit array.

Main path: SQL functions only. A level's size is bounded by ``max_bits``; a list that needs more is met by a
semi-join on the key instead (same answers). Levels shrink geometrically, so their total stays below twice the first.

Defined cases: null URLs and those without ``://`` have empty host and path; an empty host is a key like any other;
an empty list lets nothing match; an empty table gives an empty result; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, written

BITS_PER_KEY, PROBES = 10, 5
#: Verdict, host, path.
Rule = tuple[str, str, str]


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.regexp_extract(F.col(url), "(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for kind, on, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(start)
        rule = F.when(fits, f"{on}{start}") if rule is None else rule.when(fits, f"{on}{start}")
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule.otherwise(nothing), verdict.otherwise(nothing))


def probes(key: Column, level: int, bits: int) -> list[Column]:
    """The bit positions of a key: double hashing, other seeds at each level."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    first, step = F.pmod(a, F.lit(bits)), F.pmod(b, F.lit(bits - 1)) + 1  # both below bits, so no sum overflows
    return [F.pmod(first + F.lit(i) * step, F.lit(bits)) for i in range(PROBES)]


def level_bits(keys: int) -> int:
    return max(64, -(-keys * BITS_PER_KEY // 64) * 64)


def encode(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: ``words``, the filter's bits as an array of 64-bit words. Words are combined before the shuffle; the single row holds ``bits`` bits."""
    at = keys.select(F.explode(F.array(*probes(F.col("key"), level, bits))).alias("p"))
    some = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("v"))
    every = keys.sparkSession.range(0, bits // 64).withColumnRenamed("id", "w").join(some, "w", "left")
    ordered = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("all"))
    return ordered.select(F.transform("all", lambda e: e["v"]).alias("words"))


class Cascade:
    """The filters for a list of keys over a universe of keys."""

    def __init__(self, universe: DataFrame, max_bits: int = 1 << 27, max_levels: int = 64):
        """universe: rows (key, listed), one for each distinct key; it should be a written table, as each level reads it."""
        self.universe, self.levels, self.exact = universe, [], True
        counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        wrong, left = universe.where("listed"), counts.get(True, 0)
        for level in range(1, max_levels + 1):
            if not left:
                return
            bits = level_bits(left)
            if bits > max_bits:
                break
            words = written(encode(wrong, level, bits), "bloom-level")
            self.levels.append((level, bits, words))
            other = universe.where("NOT listed" if level % 2 else "listed")
            for one in self.levels:
                other = other.where(self._holds(F.col("key"), *one))
            wrong, left = other, other.count()
        self.exact = not left

    @staticmethod
    def _holds(key: Column, level: int, bits: int, words: DataFrame) -> Column:
        array, out = words.scalar(), F.lit(True)
        for p in probes(key, level, bits):
            word = F.get(array, F.shiftright(p, 6).cast("int"))
            out = out & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
        return out

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed: walk the levels until one rejects."""
        out = F.lit(len(self.levels) % 2 == 1)
        for one in reversed(self.levels):
            out = F.when(~self._holds(key, *one), F.lit(one[0] % 2 == 0)).otherwise(out)
        return out

    def mark(self, rows: DataFrame, key: str, name: str = "listed") -> DataFrame:
        """``rows`` and a boolean column: is the key listed?"""
        if self.exact:
            return rows.withColumn(name, self.member(F.col(key)))
        listed = self.universe.where("listed").select(F.col("key").alias(f"{name}_key"))
        return rows.join(listed, F.col(key).eqNullSafe(F.col(f"{name}_key")), "left").withColumn(name, F.col(f"{name}_key").isNotNull()).drop(f"{name}_key")


def judge(pages: DataFrame, rules: Sequence[Rule], listed: Column, id_col: str = "page_id", max_bits: int = 1 << 27) -> DataFrame:
    """One row per page: id, host, path, rule, listed, verdict. ``listed`` is a condition on ``host``: which hosts the block list has.

    Verdict: that of the longest rule that fits, else block if the host is listed, else allow.
    """
    rows = pages.select(F.col(id_col), *(c.alias(n) for c, n in zip(host_and_path("url"), ("host", "path"), strict=True)))
    universe = written(rows.groupBy("host").agg(F.lit(1).alias("one")).select(F.col("host").alias("key"), listed.alias("listed")), "url-keys")
    marked = Cascade(universe, max_bits).mark(rows, "host")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return marked.select(id_col, "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
