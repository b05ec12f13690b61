"""From images to rates: the composites. Each returns lazy DataFrames; writing is the caller's choice."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import crs, geometry, names
from tidemark.functions.crs import reproject
from tidemark.operators import profiles, rasters, rates, segmentation, shorelines, transects, waterlevels
from tidemark.sources import files
from tidemark.sources.options import Options

log = logging.getLogger(__name__)
#: Systems whose pictures get a longitude and a latitude.
SYSTEMS = {first + zone for first, n in (crs.NORTH, crs.SOUTH, crs.NAD83, crs.NAD83_2011) for zone in range(1, n + 1)}


@dataclass(frozen=True)
class Config:
    """What a study fixes: the model maker for segmentation, and how transects are cast."""

    make_model: Callable[[], segmentation.Model] | None = None
    transect_spacing: float = 30.0
    transect_length: float = 500.0

    def options(self) -> Options:
        return Options(transect_spacing=self.transect_spacing, transect_length=self.transect_length)


@dataclass(frozen=True)
class Result:
    """The four layers, and the coordinate system they are in."""

    shorelines: DataFrame
    baseline: DataFrame
    transects: DataFrame
    intersections: DataFrame
    epsg: int

    def rates(self) -> DataFrame:
        return transects.transect_rates(self.intersections)


def images(spark: SparkSession, folder: str, strict_listing: bool = False) -> DataFrame:
    """Rasters of a folder in path order with what their names say: image_ord, image_id, year, date and extent."""
    held = files.read_bytes(spark, folder, None if strict_listing else "*.tif*")
    read = files.guarded(files.rasters(held))
    stem = names.stem(F.col("path"))
    order = transects.numbered(read.select("path").withColumn("one", F.lit(1)), ["one"], ["path"], "image_ord").drop("one")  # a listing: small
    ext = geometry.extent(F.col("transform"), F.col("n_rows"), F.col("n_cols"))
    rows = read.join(order, "path").withColumn("year", names.year_of(stem)).withColumn("image_id", names.id_of(stem)).withColumn("date", names.date_of(F.col("year")))
    return rows.select("*", *(v.alias(k) for k, v in ext.items()))


def image_shorelines(masks: DataFrame, options: Options) -> DataFrame:
    """Shorelines of masks (image columns, mask) in map coordinates: image_ord, image_id, year, date, epsg, shoreline_id, n, vertices."""
    found = rasters.contours(masks, ["image_ord"], options.edge_distance)
    lines = shorelines.shoreline_ids(shorelines.open_contours(found, ["image_ord", "contour_id"]), ["image_ord"], "contour_id", "pos")
    lines = shorelines.long_lines(lines, ["image_ord"], "n", options.least_factor)
    about = masks.select("image_ord", "image_id", "year", "date", "epsg", "transform")

    def placed(p: Column) -> Column:
        x, y = geometry.to_geo(p["x"], p["y"], F.col("transform"))
        return geometry.point(x, y)

    joined = lines.join(about, "image_ord")
    return joined.select("image_ord", "image_id", "year", "date", "epsg", "shoreline_id", "n", F.transform("vertices", placed).alias("vertices"))


def water_masks(rows: DataFrame) -> DataFrame:
    """Masks of images: the grey value of the first bands over one."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = [rows.columns.index(c) for c in ("n_bands", "n_rows", "n_cols", "dtype", "pixels")]
    left = [k for k, c in enumerate(rows.columns) if c != "pixels"]

    def run(batches):
        for batch in batches:
            out = []
            for n, h, w, kind, data in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                bands = np.frombuffer(data, kind).reshape(n, h, w).astype(float)
                grey = bands[0] if n < 3 else np.floor(rasters.GREY[0] * bands[0] + rasters.GREY[1] * bands[1] + rasters.GREY[2] * bands[2] + 0.5)
                out.append((grey > 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in left), pa.array(out, pa.binary())], [*(batch.schema.names[k] for k in left), "mask"])

    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in left), StructField("mask", BinaryType())]))


def study_system(rows: DataFrame) -> tuple[int, set[int]]:
    """The coordinate system of the first image, and all that occur; fewer than two images are an error."""
    found = rows.groupBy("epsg").agg(F.min("image_ord").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()
    if sum(r["n"] for r in found) < 2:
        raise RuntimeError("Too few images: at least two are needed")
    return found[0]["epsg"], {r["epsg"] for r in found}


def _in_system(lines: DataFrame, target: int, systems: set[int]) -> DataFrame:
    """Vertices moved from each row's own system to the target. The systems are those of the images' headers, a handful."""
    from tidemark.functions.crs import reproject_line

    moved = F.when(F.col("epsg") == target, F.col("vertices"))
    for source in sorted(systems - {target}):
        moved = moved.when(F.col("epsg") == source, reproject_line(F.col("vertices"), source, target))
    return lines.withColumn("vertices", moved).withColumn("epsg", F.lit(target))


def _finish(lines: DataFrame, base: DataFrame, options: Options, epsg: int) -> Result:
    cast = transects.cast(base, "Id", options.transect_length, options.transect_spacing, options.smooth_factor, options.transect_orientation)
    dated = shorelines.writable(lines).select(F.col("date").alias("Date"), F.col("image_id").alias("ImageId"), "vertices")
    return Result(lines, base, cast, transects.intersect(cast, dated, options.transect_length, options.intersection_mode), epsg)


def from_folder(spark: SparkSession, folder: str, options: Options | None = None) -> Result:
    """Shorelines of all images, a baseline of what earlier images (in path order) lack, transects, and intersections."""
    options = options or Options()
    rows = images(spark, folder)
    epsg, systems = study_system(rows)
    lines = _in_system(image_shorelines(water_masks(rows), options), epsg, systems)
    extents = rows.select("image_ord", *shorelines.EXTENT)
    vertices = lines.select("image_ord", "shoreline_id", F.posexplode("vertices").alias("pos", "p")).select("image_ord", "shoreline_id", "pos", "p.x", "p.y")
    base = shorelines.baseline(vertices, extents)
    return _finish(lines, base, options, epsg)


def from_baseline(spark: SparkSession, folder: str, base: DataFrame, options: Options | None = None) -> Result:
    """As ``from_folder``, with a given baseline (Id, vertices)."""
    options = options or Options()
    rows = images(spark, folder)
    epsg, systems = study_system(rows)
    return _finish(_in_system(image_shorelines(water_masks(rows), options), epsg, systems), base, options, epsg)


def from_image(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """Shorelines of one image."""
    return image_shorelines(water_masks(images(spark, path)), options or Options())


def calibrated(spark_transects: DataFrame, found: DataFrame, levels: Mapping[int, float] | DataFrame, slope_field: str = "slope", reference: float | None = None, epsg: tuple[int, int] | None = None) -> DataFrame:
    """Water-level calibration with levels as a table or a mapping; layers in different systems are only warned of."""
    if epsg and epsg[0] != epsg[1]:
        log.warning("transects are in EPSG:%s, intersections in EPSG:%s", *epsg)
    table = levels if isinstance(levels, DataFrame) else rates.levels_from(spark_transects.sparkSession, levels)
    return rates.calibrate(spark_transects, found, table, slope_field, reference)


def enrich(lines: DataFrame, keys: list[str], tiles: DataFrame, transform: Column, tile: int, search: float = 400.0, points: int = 100) -> DataFrame:
    """Beach slope (absolute) and azimuth (from the last to the first point) of transects over a tiled elevation model."""
    sampled = profiles.sample_raster(lines, keys, tiles, transform, tile, points)
    azimuth = geometry.azimuth(F.col("x1"), F.col("y1"), F.col("x0"), F.col("y0"))
    return lines.join(sampled, keys, "left").withColumn("slope", F.abs(profiles.beach_slope(F.col("samples"), search))).withColumn("azimuth", azimuth).drop("samples")


def elevation_shift(sampled: DataFrame, keys: list[str], readings: DataFrame, dates: DataFrame, ref_dist: str = "ref_dist", length: float = 300.0) -> DataFrame:
    """Where the day's water level meets each transect's profile, counted from the far end, nearest to its intersection.

    dates: keys, Date, and the distance of the intersection; a day without a reading, or a level that is not met, is null.
    """
    dated = waterlevels.first_readings(readings, dates)
    joined = dated.join(sampled, keys, "left")
    found = F.transform(profiles.crossings(F.col("samples"), F.col("verified_m"), strict=True), lambda d: F.lit(float(length)) - d)
    return joined.withColumn("level_dist", profiles.refine(found, F.col(ref_dist))).drop("samples")


def archive_tiles(spark: SparkSession, folder: str, size: int = 1000) -> DataFrame:
    """Pictures in ZIP archives, cut to whole tiles: site, year, name, tile columns, centre lon and lat, bgr cells, and the
    picture's epsg and transform; a bad archive has an error.

    Names that begin with m or M have a fourth, infrared band.
    """
    members = files.archive_members(files.read_bytes(spark, folder, "*.[zZ][iI][pP]"))
    good = members.where("error IS NULL").select(F.concat("path", F.lit("!"), "member").alias("path"), "content")
    raster = files.rasters(good)
    name = names.base_name(F.regexp_extract("path", r"^(.*)!", 1))
    x, y = geometry.to_geo(F.floor(F.col("n_cols") / 2), F.floor(F.col("n_rows") / 2), F.col("transform"))
    lon, lat = F.lit(None).cast("double"), F.lit(None).cast("double")
    for epsg in sorted({r["epsg"] for r in raster.select("epsg").distinct().collect()} & SYSTEMS):  # those of the headers, a handful
        a, b = reproject(x, y, epsg, 4326)
        lon, lat = F.when(F.col("epsg") == epsg, a).otherwise(lon), F.when(F.col("epsg") == epsg, b).otherwise(lat)
    grid = rasters.tile_grid(F.col("n_rows"), F.col("n_cols"), size)
    placed = files.bgr_pixels(raster).select(
        names.archive_site(name).alias("site"), names.archive_year(name).alias("year"), name.alias("name"), name.rlike("^[mM]").alias("infrared"), lon.alias("lon"), lat.alias("lat"),
        "epsg", "transform", F.col("n_cols").alias("width"), "bgr", grid.alias("grid"),
    )
    rows = placed.withColumn("t", F.explode_outer("grid"))
    line = lambda r: F.substring("bgr", ((F.col("t.row0") + r) * F.col("width") + F.col("t.col0")) * 3 + 1, F.col("t.n_cols") * 3)
    cells = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("t.n_rows") - 1), line), F.unhex(F.lit("")), lambda s, x: F.concat(s, x))
    out = rows.select("site", "year", "name", "infrared", "lon", "lat", "epsg", "transform", "t.*", F.when(F.col("t").isNotNull(), cells).alias("bgr"), F.lit(None).cast("string").alias("error"))
    bad = members.where("error IS NOT NULL").select(names.base_name(F.col("path")).alias("name"), "error")
    return out.unionByName(bad, allowMissingColumns=True)
