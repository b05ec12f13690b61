"""Listings, rasters, vectors, archives and tables from any store that Spark reads, and writers for them.

Files come in through Spark's own readers, so a path may lie wherever Spark can read; bytes are decoded on the executors,
one file a row.
"""

from __future__ import annotations

import io
import json
import os
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators.waterlevels import union_by_name
from tidemark.sources import codecs

TRANSFORM = "struct<a: double, b: double, c: double, d: double, e: double, f: double>"
RASTERS = (".tif", ".tiff")


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, name, length) of every file; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", names.base_name(F.col("path")).alias("name"), "length")


def with_suffix(files: DataFrame, suffix: str) -> DataFrame:
    """Files whose last dot-separated token is the suffix, case counts."""
    return files.where(names.suffix(F.col("name")) == suffix.lstrip("."))


def ending_in(files: DataFrame, end: str) -> DataFrame:
    return files.where(F.col("name").endswith(end))


def holding(files: DataFrame, part: str = "transect", end: str = ".shp") -> DataFrame:
    return files.where(F.col("name").endswith(end) & F.contains(F.col("name"), F.lit(part)))


def folders(files: DataFrame, root: str) -> DataFrame:
    """(folder) of every folder below ``root`` that holds files, nested ones and those in between."""
    inside = F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), f"^(file:)?/*{root.rstrip('/').removeprefix('file:').lstrip('/')}/?", "")
    parts = files.select(F.split(inside, "/").alias("p")).where("p[0] <> ''").distinct()
    every = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))
    return parts.select(F.explode(every).alias("folder")).distinct()


def digit_folders(files: DataFrame, root: str) -> DataFrame:
    """Direct children whose names are digits only."""
    return folders(files, root).where(F.col("folder").rlike("^[0-9]+$"))


def path_order(path: Column) -> Column:
    """Sort key by path components."""
    return F.split(path, "/")


def read_bytes(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths if isinstance(paths, str) else list(paths)).select("path", "content")


def rasters(files: DataFrame, bands: Sequence[int] | None = None, header_only: bool = False) -> DataFrame:
    """GeoTIFFs (path, content) decoded: path, epsg, n_bands, n_rows, n_cols, dtype, nodata, transform, pixels (band after band).

    Only the bands asked for are unpacked; with ``header_only`` there are no pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = codecs.read_tiff(content, bands, header_only)
                width = r.tags[codecs.WIDTH][0]
                rows.append({
                    "path": path, "epsg": r.epsg, "n_bands": r.bands.shape[0], "n_rows": r.bands.shape[1], "n_cols": width, "dtype": str(r.bands.dtype), "nodata": r.nodata,
                    "transform": dict(zip("abcdef", r.transform, strict=True)), "pixels": None if header_only else r.bands.tobytes(),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("path", pa.string()), ("epsg", pa.int32()), ("n_bands", pa.int32()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("dtype", pa.string()), ("nodata", pa.float64()),
        ("transform", pa.struct([(k, pa.float64()) for k in "abcdef"])), ("pixels", pa.binary()),
    ])
    return files.select("path", "content").mapInArrow(run, f"path string, epsg int, n_bands int, n_rows int, n_cols int, dtype string, nodata double, transform {TRANSFORM}, pixels binary")


def bgr_pixels(raster: DataFrame, name: str = "bgr") -> DataFrame:
    """8-bit pictures from the first three bands, last band first, interleaved."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    columns = raster.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, h, w, kind, data in zip(*(batch.column(columns.index(c)).to_pylist() for c in ("n_bands", "n_rows", "n_cols", "dtype", "pixels")), strict=True):
                bands = np.frombuffer(data, kind).reshape(n, h, w)
                out.append(np.stack([bands[2], bands[1], bands[0]], -1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])

    return raster.mapInArrow(run, StructType([*raster.schema.fields, StructField(name, BinaryType())]))


def guarded(raster: DataFrame) -> DataFrame:
    """Rasters with a coordinate system and a georeference; any other is an error."""
    from tidemark.functions.geometry import checked_transform

    epsg = F.when(F.col("epsg") > 0, F.col("epsg")).otherwise(F.raise_error(F.concat(F.lit("no coordinate system: "), F.col("path"))).cast("int"))
    return raster.withColumn("epsg", epsg).withColumn("transform", checked_transform(F.col("transform")))


def archive_members(files: DataFrame, suffix: str = ".tif") -> DataFrame:
    """(path, member, content, error) of the members of ZIP archives that end in ``suffix``; a bad archive gives a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for member in sorted(archive.namelist()):
                            if member.endswith(suffix):
                                rows.append((path, member, archive.read(member), None))
                except (zipfile.BadZipFile, zlib.error, EOFError) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
                kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "member", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary, error string")


def shapefiles(spark: SparkSession, folder: str, record: str) -> DataFrame:
    """Lines of every shapefile below a folder: path, epsg, pos, vertices, and ``record`` (a schema text) for the attributes.

    The parts of a layer lie side by side in one folder, so they are joined by path and stem.
    """
    files = read_bytes(spark, folder)
    part = lambda end: files.where(F.lower("path").endswith(end)).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), F.col("content").alias(end[1:]))
    sets = part(".shp").join(part(".dbf"), "stem").join(part(".prj"), "stem", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, shp, dbf, prj in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lines, records = codecs.read_shapefile(shp, dbf)
                epsg = codecs.epsg_of((prj or b"").decode())
                rows = [{"path": stem + ".shp", "epsg": epsg, "pos": k, "vertices": [{"x": x, "y": y} for x, y in line], "record": json.dumps(r)} for k, (line, r) in enumerate(zip(lines, records, strict=True))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("path", pa.string()), ("epsg", pa.int32()), ("pos", pa.int64()), ("vertices", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("record", pa.string())])
    read = sets.select("stem", "shp", "dbf", "prj").mapInArrow(run, "path string, epsg int, pos bigint, vertices array<struct<x: double, y: double>>, record string")
    return read.withColumn("record", F.from_json("record", record)).select("path", "epsg", "pos", "vertices", "record.*")


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Line features of GeoJSON collections: pos, vertices, and the properties by a schema text; further dimensions are dropped.

    Each line of a multiple one is a row of its feature's pos. Features of other kinds are left out.
    """
    schema = f"features array<struct<properties: struct<{properties}>, geometry: string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("features").alias("pos", "f"))
    kind, held = F.get_json_object("f.geometry", "$.type"), F.get_json_object("f.geometry", "$.coordinates")
    many = F.when(kind == "LineString", F.array(F.from_json(held, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(held, "array<array<array<double>>>"))
    lines = rows.select(F.col("pos").cast("bigint").alias("pos"), "f.properties", F.explode(many).alias("line"))
    vertices = F.transform("line", lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))
    return lines.select("pos", vertices.alias("vertices"), "properties.*")


def csv_tables(spark: SparkSession, folder: str, prefix: str, suffix: str, schema: str | None = None) -> DataFrame | None:
    """All CSV files with this prefix and suffix, columns matched by name; None if there are none."""
    files = sorted(r["path"] for r in listing(spark, folder, False).where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix)).select("path").collect())
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    return union_by_name([reader.csv(f) for f in files])


def readings(table: DataFrame, date: str = "Date", value: str = "Verified (m)", order: str = "file_pos") -> DataFrame:
    """Water-level readings: file_pos, Date, verified_m, in file order."""
    return table.select(F.monotonically_increasing_id().alias(order), names.parse_date(F.col(f"`{date}`").cast("string")).alias("Date"), F.col(f"`{value}`").cast("double").alias("verified_m"))


def _put(path: str, data: bytes) -> None:
    """Write beside the target and rename, so that a lost task leaves no half file."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.create_dir(os.path.dirname(where), recursive=True)
    with store.open_output_stream(where + ".part") as out:
        out.write(data)
    store.move(where + ".part", where)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file per row, written by the executors."""

    def run(part) -> None:
        for r in part:
            _put(f"{folder.rstrip('/')}/{r[name]}", bytes(r[content]))

    rows.select(name, content).foreachPartition(run)


def write_rasters(rows: DataFrame, folder: str, name: str = "name") -> None:
    """GeoTIFFs of (name, epsg, n_bands, n_rows, n_cols, dtype, nodata, transform, pixels) rows, written by the executors."""

    def run(part) -> None:
        for r in part:
            bands = np.frombuffer(bytes(r["pixels"]), r["dtype"]).reshape(r["n_bands"], r["n_rows"], r["n_cols"])
            _put(f"{folder.rstrip('/')}/{r[name]}", codecs.write_tiff(codecs.Raster(bands, tuple(r["transform"]), r["epsg"], r["nodata"])))

    rows.foreachPartition(run)


def write_masks(rows: DataFrame, folder: str, name: str = "name") -> None:
    """Palette pictures of (name, n_rows, n_cols, mask) rows as PNG, written by the executors."""
    from tidemark.operators.segmentation import colours

    def run(part) -> None:
        for r in part:
            mask = np.frombuffer(bytes(r["mask"]), np.uint8).reshape(r["n_rows"], r["n_cols"])
            _put(f"{folder.rstrip('/')}/{r[name]}", codecs.write_png(colours(mask)[:, :, ::-1]))

    rows.foreachPartition(run)


def write_layer(lines: DataFrame, path: str, epsg: int, fields: Sequence[str], order: Sequence[str] = (), vertices: str = "vertices") -> None:
    """A line layer as a shapefile. Lines of one vertex are left out; no line at all is an error.

    A shapefile is one file with a header that counts its records, so one task writes it; use Parquet for layers beyond
    the format's 2 GB.
    """
    kept = lines.where(F.size(vertices) >= 2).select(*fields, vertices)
    if not kept.take(1):
        raise ValueError("no line has two vertices")
    kept = kept.orderBy(*(order or fields)).coalesce(1)
    base = path.removesuffix(".shp")

    def run(part) -> None:
        shapes, records = [], []
        for r in part:
            shapes.append([(p["x"], p["y"]) for p in r[vertices]])
            records.append({f: r[f] for f in fields})
        if shapes:
            for end, data in codecs.write_shapefile(shapes, records, epsg).items():
                _put(base + end, data)

    kept.foreachPartition(run)


def write_shorelines(lines: DataFrame, path: str, epsg: int, date_field: str = "Date", date_format: str = "%Y/%m/%d") -> None:
    """Layer of (date, year, image_id, vertices) rows with the fields date (as text), year, ImageId."""
    rows = lines.select(F.date_format("date", names.date_pattern(date_format)).alias(date_field), "year", F.col("image_id").alias("ImageId"), "vertices")
    write_layer(rows, path, epsg, [date_field, "year", "ImageId"], ["year", "ImageId"])


def write_baseline(lines: DataFrame, path: str, epsg: int, id_field: str = "Id") -> None:
    write_layer(lines.withColumnRenamed("Id", id_field), path, epsg, [id_field])


def position_report(centres: DataFrame, folder: str) -> None:
    """Centre positions as CSV: LON, LAT with six decimals, SAMPLE_ID, YEAR, FILE_NAME."""
    text = lambda c: F.format_string("%.6f", F.col(c))
    rows = centres.select(text("lon").alias("LON"), text("lat").alias("LAT"), F.col("site").alias("SAMPLE_ID"), F.col("year").alias("YEAR"), F.col("name").alias("FILE_NAME"))
    rows.write.mode("overwrite").option("header", "true").csv(folder)
