"""Elevation profiles along transects: sampling, crossings, beach slope.

A profile is ``array<struct<dist: double, elev: double>>`` in order of distance. Outside the raster an elevation is not
a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import NAN, to_pixel

#: What stands for "no crossing" in the compatible projection, before and after refinement. Fixed values.
NO_CROSSING, NO_REFINED = -999999.0, -999.0


def profile(dists: Column, elevs: Column) -> Column:
    return F.zip_with(dists, elevs, lambda d, e: F.struct(d.cast("double").alias("dist"), e.cast("double").alias("elev")))


def _sign(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(F.signum(x))


def crossings(samples: Column, target: Column | float, strict: bool = False) -> Column:
    """Distances where the profile crosses ``target``, linearly between samples; empty if nowhere.

    A sample on the target gives a crossing with both of its neighbours, at the same distance. A sample that is not a
    number makes crossings at an unknown distance (not a number) of both its segments; ``strict`` drops such samples.
    """
    target = F.lit(float(target)) if isinstance(target, (int, float)) else target
    kept = F.filter(samples, lambda s: ~F.isnan(s["elev"])) if strict else samples
    n = F.size(kept)
    heads, tails = F.slice(kept, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(kept, F.lit(2), F.greatest(n - 1, F.lit(0)))

    def at(a: Column, b: Column) -> Column:
        odd = F.isnan(a["elev"]) | F.isnan(b["elev"])
        rise = b["elev"] - a["elev"]
        dist = a["dist"] + (target - a["elev"]) / F.when(rise != 0, rise) * (b["dist"] - a["dist"])
        return F.when(odd, F.lit(NAN)).when(F.signum(a["elev"] - target) != F.signum(b["elev"] - target), dist)

    return F.array_compact(F.zip_with(heads, tails, at))


def refine(found: Column, reference: Column) -> Column:
    """The crossing nearest to ``reference``, the first on ties; null if there is none.

    If the first is not a number, so is the result; later ones that are not are passed over.
    """
    def nearer(best: Column, d: Column) -> Column:
        return F.when(F.isnan(best), best).when(F.isnan(d), best).when(F.abs(d - reference) < F.abs(best - reference), d).otherwise(best)

    return F.when(F.size(found) > 0, F.aggregate(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), F.get(found, F.lit(0)), nearer))


def compatible_crossings(found: Column) -> Column:
    """An empty result as the sentinel array."""
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_CROSSING)))


def compatible_refined(refined: Column) -> Column:
    return F.coalesce(refined, F.lit(NO_REFINED))


def beach_slope(samples: Column, search: Column | float = 100.0) -> Column:
    """Least-squares slope over the sample nearest to ``search`` (the first on ties) and its neighbours.

    Elevations that are not finite are left out; fewer than two give not a number, as does one distance only.
    """
    search = F.lit(float(search)) if isinstance(search, (int, float)) else search
    away = F.transform(samples, lambda s: F.abs(s["dist"] - search))
    k = F.array_position(away, F.array_min(away)).cast("int")  # from 1
    near = F.slice(samples, F.greatest(k - 1, F.lit(1)), F.least(k + 1, F.size(samples)) - F.greatest(k - 1, F.lit(1)) + 1)
    near = F.filter(near, lambda s: ~F.isnan(s["elev"]) & (F.abs(s["elev"]) < float("inf")))
    n = F.size(near)
    total = lambda f: F.aggregate(near, F.lit(0.0), lambda s, p: s + f(p))
    mean_d, mean_e = total(lambda p: p["dist"]) / n, total(lambda p: p["elev"]) / n
    held = F.struct(near.alias("p"), mean_d.alias("d"), mean_e.alias("e"))

    def slope(b: Column) -> Column:
        cov = F.aggregate(b["p"], F.lit(0.0), lambda s, p: s + (p["dist"] - b["d"]) * (p["elev"] - b["e"]))
        var = F.aggregate(b["p"], F.lit(0.0), lambda s, p: s + (p["dist"] - b["d"]) * (p["dist"] - b["d"]))
        return F.when(var > 0, cov / F.when(var > 0, var)).otherwise(F.lit(NAN))

    return F.when((F.size(samples) > 0) & (n >= 2), F.get(F.transform(F.array(held), slope), F.lit(0))).otherwise(F.lit(NAN))


def stations(x0: Column, y0: Column, x1: Column, y1: Column, n: int = 100) -> Column:
    """``n`` evenly spaced points of a transect, both ends included: array of (pos, dist, x, y)."""
    length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(steps, lambda i: F.struct(i.alias("pos"), (length * i / (n - 1)).alias("dist"), (x0 + (x1 - x0) * i / (n - 1)).alias("x"), (y0 + (y1 - y0) * i / (n - 1)).alias("y")))


def sample_raster(transects: DataFrame, keys: Sequence[str], tiles: DataFrame, transform: Column, tile: int, n: int = 100) -> DataFrame:
    """Profiles of transects (x0, y0, x1, y1) over a tiled raster (tile_row, tile_col, n_cols, cells array row by row).

    Points go to their cell (floored, nearest), cells to their tile: an equi-join, in which each tile is read once and no
    cell is exploded. Points outside have no elevation (not a number).
    """
    points = transects.select(*keys, F.explode(stations(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), n)).alias("p"))
    row, col = to_pixel(F.col("p.x"), F.col("p.y"), transform)
    points = points.withColumn("row", row).withColumn("col", col)
    points = points.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
    met = points.join(tiles.select("tile_row", "tile_col", "n_cols", "cells"), ["tile_row", "tile_col"], "left")
    r, c = F.col("row") - F.col("tile_row") * tile, F.col("col") - F.col("tile_col") * tile
    value = F.when(c < F.col("n_cols"), F.get("cells", (r * F.col("n_cols") + c).cast("int"))).cast("double")
    met = met.select(*keys, F.struct(F.col("p.pos").alias("pos"), F.col("p.dist").alias("dist"), F.coalesce(value, F.lit(NAN)).alias("elev")).alias("s"))
    by = met.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return by.select(*keys, F.transform("s", lambda s: F.struct(s["dist"].alias("dist"), s["elev"].alias("elev"))).alias("samples"))
