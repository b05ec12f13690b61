"""Whole studies: archives to segmented, merged rasters and their layers, folders and files of pictures, layers merged.

Only what a run returns or is asked to write lies in its folders; there are no staging files. Pictures are segmented tile by
tile on the executors, and a site's quadrants meet in one task, as their mosaic is one file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import crs, names
from tidemark.operators import segmentation
from tidemark.plans import composites
from tidemark.sources import codecs, files
from tidemark.sources.options import Options

#: Quadrants of a site in the order in which they are looked for. Fixed values.
DIRECTIONS = ("sw", "se", "nw", "ne")


def pictures(spark: SparkSession, folder: str, suffix: str = ".png") -> DataFrame:
    """(name, n_rows, n_cols, bgr) of the pictures of a folder, or of the <year>/<site> folders below it.

    ``name`` keeps the last two folders below ``folder``. Grey pictures get three equal bands; a file that is no picture is an error.
    """
    held = files.read_bytes(spark, folder, f"*{suffix}")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    after = F.regexp_replace(F.substring_index("path", f"{root}/", -1), r"^.*?((?:[^/]+/){0,2}[^/]+)$", "$1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    image = codecs.read_png(content)
                except Exception as e:
                    raise ValueError(f"no readable picture: {name}") from e
                colour = np.repeat(image[:, :, None], 3, 2) if image.ndim == 2 else image[:, :, 2::-1]
                own = [pa.array([name]), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([colour.astype(np.uint8).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(own, ["name", "n_rows", "n_cols", "bgr"])

    return held.select(after.alias("name"), "content").mapInArrow(run, "name string, n_rows int, n_cols int, bgr binary")


def segment_folder(spark: SparkSession, folder: str, output: str, make_model: Callable[[], segmentation.Model], suffix: str = ".png") -> None:
    """A palette picture for every picture of a folder, at the same place below ``output``. A picture itself may be given as well."""
    files.write_masks(segmentation.segment(pictures(spark, folder, suffix), make_model), output)


def segment_file(spark: SparkSession, path: str, output: str, make_model: Callable[[], segmentation.Model]) -> None:
    """One picture to one palette picture."""
    at, _, name = output.rpartition("/")
    one = pictures(spark, path, "").withColumn("name", F.lit(name))
    files.write_masks(segmentation.segment(one, make_model), at or ".")


def quadrants(tiles: DataFrame) -> DataFrame:
    """Tiles of the picture that counts for each site, year and direction: the first by name; others and names without one go."""
    where = F.lit(None).cast("string")
    for d in reversed(DIRECTIONS):
        where = F.when(F.contains(F.col("name"), F.lit(d)), F.lit(d)).otherwise(where)
    placed = tiles.withColumn("direction", where).where("direction IS NOT NULL")
    keys = ["site", "year", "direction"]
    return placed.join(placed.groupBy(*keys).agg(F.min("name").alias("name")), [*keys, "name"], "left_semi")


def mosaics(tiles: DataFrame) -> DataFrame:
    """Masks of tiles (site, year, name, epsg, transform, row0, col0, n_rows, n_cols, mask) as one colour raster per site and year.

    Returns raster rows with the name <site>/<site>_<year>.tif. Where quadrants overlap, the first by name counts; cells that
    none covers are 0. Quadrants of different systems or cell sizes are an error. A mosaic is one file, so one task holds it
    (a byte a cell, three when written).
    """
    schema = f"name string, epsg int, n_bands int, n_rows int, n_cols int, dtype string, nodata double, transform {files.TRANSFORM}, pixels binary"

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        site, year = (k.as_py() for k in key)
        held = sorted(zip(*(table.column(c).to_pylist() for c in ("name", "transform", "epsg", "row0", "col0", "n_rows", "n_cols")), range(table.num_rows), strict=True), key=lambda r: r[0], reverse=True)
        first = held[-1][1]
        if len({(r[2], r[1]["a"], r[1]["e"]) for r in held}) > 1:
            raise ValueError(f"site {site}, {year}: quadrants of different systems or cell sizes")
        left, top = min(r[1]["c"] for r in held), (max if first["e"] < 0 else min)(r[1]["f"] for r in held)
        at = []
        for _, t, _, row0, col0, h, w, k in held:
            at.append((round((t["f"] - top) / t["e"]) + row0, round((t["c"] - left) / t["a"]) + col0, h, w, k))
        water = np.zeros((max(r + h for r, _, h, _, _ in at), max(c + w for _, c, _, w, _ in at)), np.uint8)
        masks = table.column("mask")
        for r, c, h, w, k in at:  # the first by name is put last and stays
            water[r : r + h, c : c + w] = np.frombuffer(masks[k].as_py(), np.uint8).reshape(h, w) == 1
        bands = np.zeros((3, *water.shape), np.uint8)
        bands[0] = 128 * water
        row = {
            "name": f"{site}/{site}_{year}.tif", "epsg": held[-1][2], "n_bands": 3, "n_rows": water.shape[0], "n_cols": water.shape[1], "dtype": "uint8", "nodata": None,
            "transform": {**first, "c": left, "f": top}, "pixels": bands.tobytes(),
        }
        return pa.Table.from_pylist([row], schema=arrow)

    arrow = pa.schema([
        ("name", pa.string()), ("epsg", pa.int32()), ("n_bands", pa.int32()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("dtype", pa.string()), ("nodata", pa.float64()),
        ("transform", pa.struct([(k, pa.float64()) for k in "abcdef"])), ("pixels", pa.binary()),
    ])
    return tiles.select("site", "year", "name", "epsg", "transform", "row0", "col0", "n_rows", "n_cols", "mask").groupBy("site", "year").applyInArrow(run, schema)


def write_result(result: composites.Result, folder: str) -> None:
    """shoreline, baseline and transect as shapefiles, and the intersections as Parquet."""
    files.write_shorelines(result.shorelines, f"{folder}/shoreline.shp", result.epsg)
    files.write_baseline(result.baseline, f"{folder}/baseline.shp", result.epsg)
    ends: Column = F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)))
    files.write_layer(result.transects.withColumn("vertices", ends), f"{folder}/transect.shp", result.epsg, ["BaselineId", "TransectId"])
    result.intersections.write.mode("overwrite").parquet(f"{folder}/intersection")


def process_folder(spark: SparkSession, archives: str, output: str, config: composites.Config, options: Options | None = None, size: int = 1000, keep_masks: bool = False) -> composites.Result:
    """From ZIP archives of pictures to the layers in one call.

    Writes the merged rasters to Final_Folder, the layers to Result, and the masks of the tiles to binary_map if asked to.
    What is returned is lazy and reads Final_Folder. Bad archives are left out; ``composites.archive_tiles`` tells them.
    """
    if config.make_model is None:
        raise ValueError("a model maker is needed")
    tiles = composites.archive_tiles(spark, archives, size).where("error IS NULL AND bgr IS NOT NULL").drop("error")
    masks = segmentation.segment(quadrants(tiles), config.make_model)
    if keep_masks:
        place = F.concat_ws("/", "year", "site", F.concat(names.stem(F.col("name")), F.lit("_"), "tile_row", F.lit("_"), "tile_col", F.lit(".png")))
        files.write_masks(masks.withColumn("name", place), f"{output}/binary_map")
    files.write_rasters(mosaics(masks), f"{output}/Final_Folder")
    result = composites.from_folder(spark, f"{output}/Final_Folder", options or config.options())
    write_result(result, f"{output}/Result")
    return result


def process_image(spark: SparkSession, path: str, output: str, config: composites.Config, options: Options | None = None, picture: str | None = None) -> DataFrame:
    """The mask of a picture as output.png, and the shorelines of the raster at ``path`` as a layer.

    Shorelines follow the raster itself, not the mask, as in the published tool. ``picture``: a PNG to segment where the
    raster is none.
    """
    if config.make_model is None:
        raise ValueError("a model maker is needed")
    if picture:
        segment_file(spark, picture, f"{output}/output.png", config.make_model)
    else:
        bgr = files.bgr_pixels(files.rasters(files.read_bytes(spark, path))).select(F.lit("output.png").alias("name"), "n_rows", "n_cols", "bgr")
        files.write_masks(segmentation.segment(bgr, config.make_model), output)
    lines = composites.from_image(spark, path, options or config.options())
    files.write_shorelines(lines, f"{output}/shoreline.shp", lines.first()["epsg"])
    return lines


def merge_layers(spark: SparkSession, folders: Sequence[str], record: str, epsg: int = 26917) -> DataFrame:
    """Lines of all shapefiles below the folders in one system: folder, path, pos, vertices, and the attributes of ``record``.

    Write each folder's with ``files.write_layer``. A layer in an unknown system is an error.
    """
    out = None
    for folder in folders:  # a handful of named folders
        lines = files.shapefiles(spark, folder, record)
        systems = sorted(r["epsg"] for r in lines.select("epsg").distinct().collect())
        moved = F.lit(None).cast(lines.schema["vertices"].dataType)
        for source in systems:
            moved = F.when(F.col("epsg") == source, crs.reproject_line(F.col("vertices"), source, epsg)).otherwise(moved)
        lines = lines.withColumn("vertices", moved).withColumn("epsg", F.lit(epsg)).withColumn("folder", F.lit(folder))
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        raise ValueError("no folders")
    return out
