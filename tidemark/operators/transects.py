"""Transects: cast from baselines, intersected with shorelines, rated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import arc_lengths
from tidemark.operators.rates import change_rates

ENDS = ("x0", "y0", "x1", "y1")


def select_transects(transects: DataFrame, equal: Mapping[str, object]) -> DataFrame:
    """Rows that match every given value; a None asks nothing of its column."""
    for column, value in equal.items():
        if value is not None:
            transects = transects.where(F.col(column) == F.lit(value))
    return transects


def smoothed(line: Column, factor: int) -> Column:
    """Centred moving mean of ``factor`` vertices, fewer at the ends; 1 changes nothing."""
    if factor <= 1:
        return line
    half = factor // 2

    def mean(p: Column, i: Column) -> Column:
        a = F.greatest(i - half, F.lit(0))
        near = F.slice(line, a + 1, F.least(i + half, F.size(line) - 1) - a + 1)
        total = F.aggregate(near, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, q: F.struct((s["x"] + q["x"]).alias("x"), (s["y"] + q["y"]).alias("y")))
        return F.struct((total["x"] / F.size(near)).alias("x"), (total["y"] / F.size(near)).alias("y"))

    return F.transform(line, mean)


def cast(baselines: DataFrame, id_field: str = "Id", length: float = 500.0, spacing: float = 30.0, smooth: int = 1, orientation: str = "mix", vertices: str = "vertices") -> DataFrame:
    """Perpendiculars every ``spacing`` of arc length: BaselineId, TransectId from 0, x0, y0, x1, y1, bx, by (the point on the baseline).

    ``left`` and ``right`` cast the whole length to one side, ``mix`` half to each. Baselines of no length cast nothing.
    """
    if orientation not in ("left", "right", "mix"):
        raise ValueError(f"unknown orientation {orientation!r}")
    lines = baselines.where(F.size(vertices) >= 2).select(F.col(id_field).alias("BaselineId"), smoothed(F.col(vertices), smooth).alias("v"))
    lines = lines.withColumn("s", arc_lengths(F.col("v"))).withColumn("l", F.element_at("s", -1)).where("l > 0")
    at = lines.select("BaselineId", "v", "s", F.posexplode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("l") / spacing)), lambda k: k * F.lit(float(spacing)))).alias("k", "d"))
    seg = F.least(F.greatest(F.size(F.filter("s", lambda c: c < F.col("d"))), F.lit(1)), F.size("v") - 1)
    at = at.withColumn("i", seg).withColumn("a", F.get("v", F.col("i") - 1)).withColumn("b", F.get("v", F.col("i"))).withColumn("w", F.get("s", F.col("i")) - F.get("s", F.col("i") - 1))
    dx, dy, t = (F.col("b.x") - F.col("a.x")) / F.col("w"), (F.col("b.y") - F.col("a.y")) / F.col("w"), F.col("d") - F.get("s", F.col("i") - 1)
    at = at.where("w > 0").select("BaselineId", F.col("k").cast("bigint").alias("TransectId"), (F.col("a.x") + t * dx).alias("bx"), (F.col("a.y") + t * dy).alias("by"), (-dy).alias("nx"), dx.alias("ny"))
    back, ahead = {"left": (0.0, length), "right": (0.0, -length), "mix": (-length / 2, length / 2)}[orientation]
    end = lambda p, q, m: (F.col(p) + F.col(q) * F.lit(float(m)))
    return at.select("BaselineId", "TransectId", end("bx", "nx", back).alias("x0"), end("by", "ny", back).alias("y0"), end("bx", "nx", ahead).alias("x1"), end("by", "ny", ahead).alias("y1"), "bx", "by")


def segments(lines: DataFrame, keep: Sequence[str], vertices: str = "vertices") -> DataFrame:
    """Each line's segments: kept columns, sx0, sy0, sx1, sy1."""
    v = F.col(vertices)
    n = F.greatest(F.size(v) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("sx0"), a["y"].alias("sy0"), b["x"].alias("sx1"), b["y"].alias("sy1")))
    return lines.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> Column:
    """Grid cells of a segment's bounding box."""
    a = lambda f, p, q: F.floor(f(p, q) / F.lit(float(cell)))
    xs, ys = F.sequence(a(F.least, x0, x1), a(F.greatest, x0, x1)), F.sequence(a(F.least, y0, y1), a(F.greatest, y0, y1))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def crossings(transects: DataFrame, pieces: DataFrame, keep: Sequence[str], cell: float) -> DataFrame:
    """Every crossing of a transect with a shoreline segment: BaselineId, TransectId, kept columns, ref_dist, x, y.

    Both sides go to the grid cells their bounding boxes meet; the join is on the cell, and a pair counts in the one
    cell that holds the crossing, so nothing has to be made distinct. ref_dist is signed, from the baseline's point
    along the transect.
    """
    def sided(rows: DataFrame, kept: Sequence[str], ends: Sequence[str], p: str) -> DataFrame:
        """Kept columns, start, direction and bounding box (names begin with p), once for each cell."""
        x0, y0, x1, y1 = (F.col(c) for c in ends)
        own = {"x": x0, "y": y0, "dx": x1 - x0, "dy": y1 - y0, "left": F.least(x0, x1), "right": F.greatest(x0, x1), "low": F.least(y0, y1), "high": F.greatest(y0, y1)}
        return rows.select(*kept, *(v.alias(p + k) for k, v in own.items()), F.explode(_cells(x0, y0, x1, y1, cell)).alias("c")).select("*", "c.cx", "c.cy").drop("c")

    # what a pair needs is computed before the join, so that its expressions stay small enough to be compiled
    t = sided(transects, ("BaselineId", "TransectId", "bx", "by"), ENDS, "t_")
    s = sided(pieces, keep, ("sx0", "sy0", "sx1", "sy1"), "s_")
    met = t.join(s, ["cx", "cy"]).where("t_left <= s_right AND s_left <= t_right AND t_low <= s_high AND s_low <= t_high AND t_dx * s_dy - t_dy * s_dx <> 0")
    across, along = ("((s_x - t_x) * s_dy - (s_y - t_y) * s_dx)", "((s_x - t_x) * t_dy - (s_y - t_y) * t_dx)")
    met = met.withColumn("at", F.explode(F.array(F.struct(F.expr(f"{across} / (t_dx * s_dy - t_dy * s_dx)").alias("u"), F.expr(f"{along} / (t_dx * s_dy - t_dy * s_dx)").alias("v")))))
    met = met.where("at.u BETWEEN 0 AND 1 AND at.v BETWEEN 0 AND 1").withColumn("x", F.expr("t_x + at.u * t_dx")).withColumn("y", F.expr("t_y + at.u * t_dy"))
    # the cell of the crossing, held within both bounding boxes against rounding
    held = lambda p, low, high: F.floor(F.greatest(F.least(p, f"t_{high}", f"s_{high}"), f"t_{low}", f"s_{low}") / F.lit(float(cell)))
    met = met.where((F.col("cx") == held("x", "left", "right")) & (F.col("cy") == held("y", "low", "high")))
    distance = F.expr("((x - bx) * t_dx + (y - by) * t_dy) / sqrt(t_dx * t_dx + t_dy * t_dy)")
    return met.select("BaselineId", "TransectId", *keep, distance.alias("ref_dist"), "x", "y")


def pick(found: DataFrame, keys: Sequence[str], mode: str = "closest") -> DataFrame:
    """One crossing per key: the least or the greatest absolute ref_dist, ties by ref_dist, x, y."""
    if mode not in ("closest", "farthest"):
        raise ValueError(f"unknown mode {mode!r}")
    size = F.abs("ref_dist") if mode == "closest" else -F.abs("ref_dist")
    rest = [c for c in found.columns if c not in keys]
    by = found.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(size.alias("o"), "ref_dist", "x", "y")).alias("p"))
    return by.select(*keys, "p.*")


def intersect(transects: DataFrame, shorelines: DataFrame, cell: float, mode: str = "closest", date_field: str = "Date") -> DataFrame:
    """BaselineId, TransectId, Date, ImageId, ref_dist, x, y: one row per transect and dated shoreline image."""
    keep = [date_field, "ImageId"]
    return pick(crossings(transects, segments(shorelines, keep), keep, cell), ["BaselineId", "TransectId", *keep], mode)


def transect_rates(found: DataFrame, date_field: str = "Date", unit: str = "year") -> DataFrame:
    """BaselineId, TransectId, n, ChangeRate of ref_dist per year; ``unit`` day counts fractional years. Transects with one date have rate 0."""
    day = F.col(date_field)
    t = F.year(day) if unit == "year" else F.datediff(day, F.lit("1970-01-01").cast("date")) / 365.25
    rates = change_rates(found, ["BaselineId", "TransectId"], t, F.col("ref_dist"))
    return rates.withColumn("ChangeRate", F.coalesce("ChangeRate", F.lit(0.0)))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with a number from 0 within their group."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))
