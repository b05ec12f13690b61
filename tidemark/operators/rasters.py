"""Tiled rasters: cutting, stitching, mosaics, masks, and border following.

A raster is rows (tile_row, tile_col, n_rows, n_cols, cells): cells are an array in row order. Whole-image kernels that
no expression can give (border following) run on Arrow batches, one image a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blue, green, red weights of the grey value, in that order for (r, g, b). Fixed values.
GREY = (0.299, 0.587, 0.114)


def tile_grid(rows: Column, cols: Column, size: int = 1000, keep_rest: bool = False) -> Column:
    """Array of (tile_row, tile_col, row0, col0, n_rows, n_cols).

    Only whole tiles; what remains at the right and the bottom is dropped, or goes to the last tiles with ``keep_rest``.
    An image smaller than a tile has none.
    """
    down, across = F.floor(rows / size).cast("int"), F.floor(cols / size).cast("int")
    none = F.expr("CAST(array() AS array<struct<tile_row: int, tile_col: int, row0: int, col0: int, n_rows: int, n_cols: int>>)")

    def tile(i: Column, j: Column) -> Column:
        last_i, last_j = (i == down - 1) & F.lit(keep_rest), (j == across - 1) & F.lit(keep_rest)
        return F.struct(
            i.alias("tile_row"), j.alias("tile_col"), (i * size).alias("row0"), (j * size).alias("col0"),
            F.when(last_i, rows.cast("int") - i * size).otherwise(F.lit(size)).alias("n_rows"),
            F.when(last_j, cols.cast("int") - j * size).otherwise(F.lit(size)).alias("n_cols"),
        )

    grid = F.flatten(F.transform(F.sequence(F.lit(0), down - 1), lambda i: F.transform(F.sequence(F.lit(0), across - 1), lambda j: tile(i, j))))
    return F.when((down > 0) & (across > 0), grid).otherwise(none)


def cut(images: DataFrame, keys: Sequence[str], size: int = 1000, keep_rest: bool = False) -> DataFrame:
    """Images (keys, n_rows, n_cols, cells) to tiles, each with its own cells."""
    grid = images.select(*keys, "cells", F.col("n_cols").alias("_w"), F.explode(tile_grid(F.col("n_rows"), F.col("n_cols"), size, keep_rest)).alias("t"))
    lines = F.transform(F.sequence(F.lit(0), F.col("t.n_rows") - 1), lambda r: F.slice("cells", (F.col("t.row0") + r) * F.col("_w") + F.col("t.col0") + 1, F.col("t.n_cols")))
    return grid.select(*keys, "t.*", F.flatten(lines).alias("cells"))


def max_dims(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest tile row and column of each image."""
    return tiles.groupBy(*keys).agg(F.max("tile_row").alias("max_row"), F.max("tile_col").alias("max_col"))


def stitch(pixels: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Pixels of tiles (tile_row, tile_col, r, c, value) in the coordinates of the whole image: keys, row, col, value."""
    return pixels.select(*keys, (F.col("tile_row") * tile + F.col("r")).alias("row"), (F.col("tile_col") * tile + F.col("c")).alias("col"), "value")


def assemble(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles of one size back to images: keys, n_rows, n_cols, cells. A tile missing from the grid is an error.

    Rows of pixels are joined tile by tile, then row by row; an image's tiles meet in one task, as the image is one row.
    """
    by_row = tiles.groupBy(*keys, "tile_row").agg(
        F.array_sort(F.collect_list(F.struct("tile_col", "n_cols", "cells"))).alias("t"), F.max("n_rows").alias("n_rows"), F.sum("n_cols").alias("width"), F.max("tile_col").alias("last"), F.count(F.lit(1)).alias("_tiles")
    )
    line = lambda r: F.flatten(F.transform("t", lambda t: F.slice(t["cells"], r * t["n_cols"] + 1, t["n_cols"])))
    strip = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), line))
    strips = by_row.select(*keys, "tile_row", "n_rows", "width", (F.col("last") + 1 - F.col("_tiles")).alias("gaps"), strip.alias("cells"))
    whole = strips.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("tile_row", "cells"))).alias("s"), F.sum("n_rows").alias("n_rows"), F.max("width").alias("n_cols"), F.min("width").alias("narrow"),
        (F.sum("gaps") + F.max("tile_row") + 1 - F.count(F.lit(1))).alias("gaps"),
    )
    complete = (F.col("gaps") == 0) & (F.col("narrow") == F.col("n_cols"))
    cells = F.when(complete, F.flatten(F.col("s")["cells"])).otherwise(F.raise_error(F.lit("tiles are missing")))
    return whole.select(*keys, F.col("n_rows").cast("int"), F.col("n_cols").cast("int"), cells.alias("cells"))


def mosaic(pixels: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """One value per cell: that of the first source that has one (not null), sources in ``order``."""
    return pixels.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor(GREY[0] * r + GREY[1] * g + GREY[2] * b + 0.5)


def foreground(r: Column, g: Column, b: Column, threshold: int = 1) -> Column:
    """Is the grey value over the threshold? Strictly: a value of 1 is background."""
    return grey(r, g, b) > threshold


def palette(mask: Column) -> Column:
    """Colour (r, g, b) of a class: water is dark red, the rest black."""
    water = F.when(mask == 1, 128).otherwise(0)
    return F.struct(water.alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))


def resample_nearest(width: Column, height: Column, source_row: Column, source_col: Column) -> Column:
    """Index of the cell that holds an inverse-mapped point, null outside."""
    inside = (source_row >= 0) & (source_row < height) & (source_col >= 0) & (source_col < width)
    return F.when(inside, source_row * width + source_col)


# Border following after Suzuki and Abe (1985), algorithm 1. Neighbours clockwise on screen, from east. Fixed values.
_STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def follow_borders(mask: np.ndarray) -> list[tuple[bool, list[tuple[int, int]]]]:
    """(is a hole, vertices (col, row)) of every border of the 8-connected foreground, straight runs reduced to their ends."""
    height, width = mask.shape
    f = np.zeros((height + 2, width + 2), np.int32)
    f[1:-1, 1:-1] = mask != 0
    number, found = 1, []
    starts = np.argwhere((f[:, 1:-1] != 0) & ((f[:, :-2] == 0) | (f[:, 2:] == 0)))
    for i, j in starts:
        j = int(j) + 1
        i = int(i)
        for hole in (False, True):
            if (f[i, j] == 1 and f[i, j - 1] == 0) if not hole else (f[i, j] >= 1 and f[i, j + 1] == 0):
                number += 1
                found.append((hole, _reduced(_follow(f, i, j, 4 if not hole else 0, number))))
                break
    return found


def _follow(f: np.ndarray, i: int, j: int, direction: int, number: int) -> list[tuple[int, int]]:
    """Trace one border from (i, j), where ``direction`` points at the background; marks ``f`` and returns (col, row) without the frame."""
    first = next((k % 8 for k in range(direction, direction + 8) if f[i + _STEPS[k % 8][0], j + _STEPS[k % 8][1]]), None)
    if first is None:
        f[i, j] = -number
        return [(j - 1, i - 1)]
    end = (i + _STEPS[first][0], j + _STEPS[first][1])
    at, came, out = (i, j), first, []
    while True:
        east_empty, k = False, came
        for step in range(1, 9):
            k = (came - step) % 8
            if f[at[0] + _STEPS[k][0], at[1] + _STEPS[k][1]]:
                break
            east_empty |= k == 0
        if east_empty:
            f[at] = -number
        elif f[at] == 1:
            f[at] = number
        out.append((at[1] - 1, at[0] - 1))
        following = (at[0] + _STEPS[k][0], at[1] + _STEPS[k][1])
        if following == (i, j) and at == end:
            return out
        at, came = following, (k + 4) % 8


def _reduced(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed chain without the vertices at which the direction stays the same."""
    n = len(points)
    if n < 3:
        return points
    step = [(points[(k + 1) % n][0] - points[k][0], points[(k + 1) % n][1] - points[k][1]) for k in range(n)]
    return [p for k, p in enumerate(points) if step[k] != step[k - 1]] or points[:1]


def contours(images: DataFrame, keys: Sequence[str], margin: int = 100, strict: bool = True) -> DataFrame:
    """Contour vertices of masks (keys, n_rows, n_cols, mask binary): keys, contour_id, hole, pos, x, y, edge.

    ``edge``: within ``margin`` of a border, inclusive. An image without contours, or with none at its edge, is an error
    if ``strict``, else it has no rows.
    """
    fields = [images.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", contour_id int, hole boolean, pos int, x int, y int, edge boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (h, w, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_rows", "n_cols", "mask")), strict=True)):
                found = follow_borders(np.frombuffer(data, np.uint8).reshape(h, w))
                rows = [(c, hole, p, x, y, x <= margin or y <= margin or x >= w - margin or y >= h - margin) for c, (hole, line) in enumerate(found) for p, (x, y) in enumerate(line)]
                if strict and not any(r[-1] for r in rows):
                    raise RuntimeError("no contours" if not rows else "no contour touches the image's edge")
                if rows:
                    kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                    own = [pa.array([batch.column(k)[i].as_py()] * len(rows), batch.schema.field(k).type) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [*keys, "contour_id", "hole", "pos", "x", "y", "edge"])

    return images.select(*keys, "n_rows", "n_cols", "mask").mapInArrow(run, schema)
