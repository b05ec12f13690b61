"""Polylines, extents and affine maps as Column expressions.

A polyline is ``array<struct<x: double, y: double>>``; its order is the array's. All expressions stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polyline(flat: Column) -> Column:
    """Interleaved x, y, x, y, ... to a polyline; a last odd value is dropped."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: point(F.get(flat, 2 * i), F.get(flat, 2 * i + 1)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def arc_lengths(line: Column) -> Column:
    """Length from the first vertex to each vertex; as many numbers as vertices."""
    steps = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), distance)
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))


def _along(line: Column, sums: Column, target: Column) -> Column:
    """The point at an arc length, on the first segment that ends there or later."""

    def on(k: Column) -> Column:
        a, b, start, end = F.get(line, k - 1), F.get(line, k), F.get(sums, k - 1), F.get(sums, k)
        return let(ieee_divide(target - start, end - start), lambda t: point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])))

    return let(F.least(F.greatest(F.size(F.filter(sums, lambda c: c < target)), F.lit(1)), F.size(line) - 1), on)


def resample(line: Column, n: Column | int) -> Column:
    """``n`` points evenly spaced by arc length, both ends exact.

    Fewer than two points asked for, or fewer than two vertices, is an error; a line of no length repeats its first vertex.
    """
    n = F.lit(n) if isinstance(n, int) else n
    points = let(
        F.struct(line.alias("v"), arc_lengths(line).alias("s")),
        lambda b: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.when((i == 0) | (F.element_at(b["s"], -1) == 0) & (i < n - 1), F.get(b["v"], F.lit(0)))
            .when(i == n - 1, F.element_at(b["v"], -1))
            .otherwise(let(i * F.element_at(b["s"], -1) / (n - 1), lambda target: _along(b["v"], b["s"], target))),
        ),
    )
    return F.when((n >= 2) & (F.size(line) >= 2), points).otherwise(F.raise_error(F.lit("resampling takes two points and two vertices at least")))


def discrete_frechet(a: Column, b: Column) -> Column:
    """Discrete Fréchet distance of the given vertices: the coupling table row by row."""
    far = F.lit(float("inf"))

    def row(before: Column, p: Column, first: Column) -> Column:
        def cell(s: Column, j: Column) -> Column:
            up, corner = F.get(before, j), F.when(j > 0, F.get(before, j - 1)).otherwise(far)
            best = F.when(first & (j == 0), F.lit(0.0)).otherwise(F.least(up, corner, F.when(j > 0, F.element_at(s, -1)).otherwise(far)))
            return F.concat(s, F.array(F.greatest(distance(p, F.get(b, j)), best)))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.expr("CAST(array() AS array<double>)"), cell)

    start = F.struct(F.array_repeat(far, F.size(b)).alias("row"), F.lit(True).alias("first"))
    table = F.aggregate(a, start, lambda s, p: F.struct(row(s["row"], p, s["first"]).alias("row"), F.lit(False).alias("first")), lambda s: F.element_at(s["row"], -1))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), table).otherwise(F.raise_error(F.lit("an empty line has no distance")))


def modified_frechet(a: Column, b: Column) -> Column:
    """Largest less smallest gap between the two lines, both resampled to the larger number of vertices."""
    n = F.greatest(F.size(a), F.size(b))
    return let(F.zip_with(resample(a, n), resample(b, n), distance), lambda gaps: F.array_max(gaps) - F.array_min(gaps))


def orientation_free_frechet(a: Column, b: Column) -> Column:
    """The smaller of the modified distances of ``a`` and of ``a`` reversed. Resampling a reversed line reverses its points up to rounding, but both are resampled, as their first matches may differ."""
    return F.least(modified_frechet(a, b), modified_frechet(F.reverse(a), b))


def azimuth(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north; 0 for equal points."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)) + 360.0, F.lit(360.0))


def overlaid(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Do two extents (xmin, xmax, ymin, ymax) meet, borders included?"""
    return (a["xmax"] >= b["xmin"]) & (b["xmax"] >= a["xmin"]) & (a["ymax"] >= b["ymin"]) & (b["ymax"] >= a["ymin"])


def within(x: Column, y: Column, extent: dict[str, Column]) -> Column:
    """Is a point in an extent, borders included?"""
    return x.between(extent["xmin"], extent["xmax"]) & y.between(extent["ymin"], extent["ymax"])


def to_geo(col: Column, row: Column, t: Column) -> tuple[Column, Column]:
    """Affine map of a pixel corner; ``t`` has a to f: x = a col + b row + c, y = d col + e row + f."""
    return t["a"] * col + t["b"] * row + t["c"], t["d"] * col + t["e"] * row + t["f"]


def to_pixel(x: Column, y: Column, t: Column) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point: the inverse map, floored."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    dx, dy = x - t["c"], y - t["f"]
    return F.floor((t["a"] * dy - t["d"] * dx) / det), F.floor((t["e"] * dx - t["b"] * dy) / det)


def window_transform(t: Column, row: Column, col: Column) -> Column:
    """The affine map of a sub-window that starts at (row, col)."""
    x, y = to_geo(col, row, t)
    return F.struct(t["a"].alias("a"), t["b"].alias("b"), x.alias("c"), t["d"].alias("d"), t["e"].alias("e"), y.alias("f"))


def extent(t: Column, rows: Column, cols: Column) -> dict[str, Column]:
    """Bounds from an affine map without its rotation terms; a map that is the identity is an error where ``checked_transform`` guards it."""
    x0, x1, y0, y1 = t["c"], t["c"] + t["a"] * cols, t["f"], t["f"] + t["e"] * rows
    return {"xmin": F.least(x0, x1), "xmax": F.greatest(x0, x1), "ymin": F.least(y0, y1), "ymax": F.greatest(y0, y1)}


def checked_transform(t: Column) -> Column:
    """``t``, or an error if it is the identity, which means that an image has no georeference."""
    same = (t["a"] == 1) & (t["b"] == 0) & (t["c"] == 0) & (t["d"] == 0) & (t["e"] == 1) & (t["f"] == 0)
    return F.when(~same, t).otherwise(F.raise_error(F.lit("the image has no georeference")))


def near_edge(col: Column, row: Column, cols: Column, rows: Column, margin: Column | int) -> Column:
    """Is a pixel within ``margin`` of a border, inclusive on both sides?"""
    m = F.lit(margin) if isinstance(margin, int) else margin
    return (col <= m) | (row <= m) | (col >= cols - m) | (row >= rows - m)


def ieee_divide(a: Column, b: Column) -> Column:
    """Floating division without errors: x/0 is an infinity, 0/0 not a number."""
    return (
        F.when(b != 0, a / F.when(b != 0, b))
        .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(a) | (a == 0), F.lit(NAN))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
