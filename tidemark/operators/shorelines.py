"""From contour vertices to shorelines and a baseline without repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.crs import reproject_line
from tidemark.functions.geometry import overlaid, point, within

EXTENT = ("xmin", "xmax", "ymin", "ymax")


def open_contours(vertices: DataFrame, keys: Sequence[str], edge: str = "edge") -> DataFrame:
    """Vertices of contours that touch the image's edge; closed ones are islands or ponds, no shoreline."""
    touching = vertices.groupBy(*keys).agg(F.bool_or(edge).alias("_e")).where("_e").drop("_e")
    return vertices.join(touching, list(keys), "left_semi")


def edge_runs(vertices: DataFrame, image: Sequence[str], contour: str, pos: str, edge: str = "edge") -> DataFrame:
    """Inner vertices with ``run``, the number of edge vertices before them in their contour: a run is a maximal stretch between edge vertices.

    A closed contour is not joined across its start.
    """
    w = Window.partitionBy(*image, contour).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return vertices.withColumn("run", F.sum(F.col(edge).cast("bigint")).over(w)).where(~F.col(edge))


def shoreline_ids(vertices: DataFrame, image: Sequence[str], contour: str, pos: str, edge: str = "edge", x: str = "x", y: str = "y") -> DataFrame:
    """Runs as shorelines: image keys, shoreline_id, n, vertices.

    Every contour's start takes an id and so does every end of a non-empty run at an edge vertex, whether a line follows
    or not, so ids have gaps. Two steps: lines per contour (bounded by a contour), then running counts per image.
    """
    w = Window.partitionBy(*image, contour).orderBy(pos)
    marked = vertices.withColumn("_run", F.sum(F.col(edge).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = marked.withColumn("_flush", F.col(edge) & ~F.coalesce(F.lag(edge).over(w), F.lit(True)))
    runs = marked.groupBy(*image, contour, "_run").agg(
        F.array_sort(F.collect_list(F.when(~F.col(edge), F.struct(F.col(pos).alias("pos"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))).alias("_v"),
        F.max(F.col("_flush").cast("bigint")).alias("_flush"),
    )
    before = Window.partitionBy(*image).orderBy(contour, "_run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(Window.partitionBy(*image, contour).orderBy("_run")) == 1
    named = runs.withColumn("_first", first.cast("bigint")).withColumn("shoreline_id", F.sum(F.col("_first") + F.col("_flush")).over(before) - 1)
    lines = named.where(F.size("_v") > 0)
    return lines.select(*image, contour, "shoreline_id", F.size("_v").cast("bigint").alias("n"), F.transform("_v", lambda v: point(v["x"], v["y"])).alias("vertices"))


def long_lines(lines: DataFrame, image: Sequence[str], n: str = "n", least_factor: float = 0.5) -> DataFrame:
    """Lines with at least ``least_factor`` times the vertices of their image's longest, that bound truncated."""
    most = lines.groupBy(*image).agg(F.floor(F.max(n) * F.lit(float(least_factor))).alias("_least"))
    return lines.join(most, list(image)).where(F.col(n) >= F.col("_least")).drop("_least")


def writable(lines: DataFrame, vertices: str = "vertices") -> DataFrame:
    """Lines of two vertices at least."""
    return lines.where(F.size(vertices) >= 2)


def _side(extents: DataFrame) -> Column:
    """Cell side of a grid for these extents, one number: the mean side, or a part of the largest one, so that none has over 66 cells a side."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return extents.agg(F.greatest(F.avg(side), F.max(side) / 64, F.lit(1e-9)).alias("s")).scalar()


def _gridded(extents: DataFrame, side: Column) -> DataFrame:
    """Extents in every cell that they touch: all columns, cx and cy."""
    cells = lambda c: F.sequence(F.floor(F.col(f"{c}min") / F.col("_s")), F.floor(F.col(f"{c}max") / F.col("_s")))
    known = extents.where("xmin <= xmax AND ymin <= ymax").withColumn("_s", side)
    return known.withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y"))).drop("_s")


def new_vertices(vertices: DataFrame, extents: DataFrame, order: str = "image_ord", x: str = "x", y: str = "y") -> DataFrame:
    """Vertices that lie in no earlier image's extent: an anti-join on grid cells."""
    side = _side(extents)
    held = _gridded(extents.select(order, *EXTENT), side).select(F.col(order).alias("_o"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), *(F.col(c).alias(f"_{c}") for c in EXTENT))
    seen = (F.col("_o") < F.col(order)) & within(F.col(x), F.col(y), {c: F.col(f"_{c}") for c in EXTENT})
    placed = vertices.withColumn("_vx", F.floor(F.col(x) / side)).withColumn("_vy", F.floor(F.col(y) / side))
    return placed.join(held, (F.col("_vx") == F.col("_cx")) & (F.col("_vy") == F.col("_cy")) & seen, "left_anti").drop("_vx", "_vy")


def baseline(vertices: DataFrame, extents: DataFrame, order: str = "image_ord", line: str = "shoreline_id", pos: str = "pos") -> DataFrame:
    """Lines of the vertices that earlier images lack: Id from 0 in (image, line) order, n, vertices.

    What survives of a line stays one line, its gaps bridged. Lines are numbered within their image, and images, one row
    each, have offsets.
    """
    kept = new_vertices(vertices, extents, order)
    lines = kept.groupBy(order, line).agg(F.array_sort(F.collect_list(F.struct(pos, "x", "y"))).alias("_v"))
    ahead = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.select(order, line).distinct().groupBy(order).agg(F.count(F.lit(1)).alias("_n"))
    lines = lines.join(counts.select(order, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")), order)
    number = F.col("_ahead") + F.row_number().over(Window.partitionBy(order).orderBy(line)) - 1
    return lines.select(number.cast("bigint").alias("Id"), order, line, F.size("_v").cast("bigint").alias("n"), F.transform("_v", lambda v: point(v["x"], v["y"])).alias("vertices"))


def overlapping_pairs(extents: DataFrame, key: str) -> DataFrame:
    """(a, b) of extents that meet, a < b: they join on grid cells, and a pair counts in the cell where their common part begins."""
    cell = _side(extents)
    gridded = _gridded(extents.select(key, *EXTENT), cell)
    a, b = (gridded.select(F.col(key).alias(p), "cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in EXTENT)) for p in "ab")
    side = lambda p: {c: F.col(f"{p}_{c}") for c in EXTENT}
    met = a.join(b, ["cx", "cy"]).where((F.col("a") < F.col("b")) & overlaid(side("a"), side("b"))).withColumn("_s", cell)
    first = lambda c: F.floor(F.greatest(f"a_{c}min", f"b_{c}min") / F.col("_s"))
    return met.where((F.col("cx") == first("x")) & (F.col("cy") == first("y"))).select("a", "b")


def union_lines(lines: Sequence[tuple[DataFrame, int]], epsg: int, vertices: str = "vertices") -> DataFrame | None:
    """All lines in one system; equal systems are left alone."""
    out = None
    for frame, source in lines:
        moved = frame.withColumn(vertices, reproject_line(F.col(vertices), source, epsg))
        out = moved if out is None else out.unionByName(moved)
    return out


def meta_by_id_year(name: Column, sample: Column, year: Column) -> Column:
    """Does a file name hold both numbers anywhere?"""
    return F.contains(name, year.cast("int").cast("string")) & F.contains(name, sample.cast("int").cast("string"))


def label_files(files: Column, label: Column) -> Column:
    return F.filter(files, lambda f: F.contains(f, label))


def by_direction(files: Column, direction: Column) -> Column:
    """The first file that holds the direction, else an empty name."""
    return F.coalesce(F.get(label_files(files, direction), F.lit(0)), F.lit(""))


def date_for_year(files: Column, directions: Sequence[str] = ("sw", "se", "nw", "ne")) -> Column:
    """The last underscore token of the first direction's file that exists."""
    name = F.lit("")
    for d in reversed(directions):
        found = by_direction(files, F.lit(d))
        name = F.when(found != "", found).otherwise(name)
    return F.element_at(F.split(F.get(F.split(name, r"\."), F.lit(0)), "_"), -1)


def chosen_candidates(files: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """Of each group's files: those of the ``_h_`` variant if both it and ``_1_`` exist, then those of the first one's eight-digit date."""
    group = Window.partitionBy(*keys)
    has = lambda mark: F.bool_or(F.contains(F.col(name), F.lit(mark))).over(group)
    kept = files.withColumn("_both", has("_1_") & has("_h_")).where(~F.col("_both") | F.contains(F.col(name), F.lit("_h_"))).drop("_both")
    day = F.regexp_extract(name, r"_(\d{8})", 1)
    return kept.withColumn("_d", day).withColumn("_f", F.min_by("_d", name).over(group)).where("_d = _f").drop("_d", "_f")
