"""Codecs, files, composites and streams."""

import datetime
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rates
from tidemark.plans import composites
from tidemark.sources import codecs, files
from tidemark.sources.options import Options
from tidemark.streaming.rates import streaming_rates

LINE = "array<struct<x: double, y: double>>"


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32", "float64"])
@pytest.mark.parametrize("deflate", [True, False])
def test_tiff(dtype, deflate):
    bands = (np.random.default_rng(0).random((4, 300, 170)) * 200).astype(dtype)
    r = codecs.read_tiff(codecs.write_tiff(codecs.Raster(bands, (2.0, 0.5, 1000.0, 0.25, -2.0, 5000.0), 26917, -9.0), deflate))
    assert (r.bands == bands).all() and r.bands.dtype == dtype and r.transform == (2.0, 0.5, 1000.0, 0.25, -2.0, 5000.0) and (r.epsg, r.nodata) == (26917, -9)
    assert (codecs.read_tiff(codecs.write_tiff(codecs.Raster(bands)), [3, 1]).bands == bands[[2, 0]]).all()


def test_png():
    rng = np.random.default_rng(0)
    for image in (rng.integers(0, 256, (20, 31, 3), np.uint8), rng.integers(0, 256, (5, 7), np.uint8)):
        assert (codecs.read_png(codecs.write_png(image)) == image).all()
    with pytest.raises(ValueError, match="PNG"):
        codecs.read_png(b"nothing")


def test_shapefile_bytes():
    lines, records = [[(0.0, 1.0), (2.5, 3.0)], [(1.0, 1.0), (2.0, 2.0), (3.0, 1.0)]], [{"Date": "2001/01/01", "year": 2001, "rate": 0.125}, {"Date": "é", "year": -5, "rate": None}]
    data = codecs.write_shapefile(lines, records, 26917)
    assert codecs.read_shapefile(data[".shp"], data[".dbf"]) == (lines, records) and codecs.epsg_of(data[".prj"].decode()) == 26917
    assert len(data[".shx"]) == 100 + 16 and int.from_bytes(data[".shp"][24:28], "big") * 2 == len(data[".shp"])


def test_layers(spark, tmp_path):
    rows = [(0, 1, 2001, datetime.date(2001, 1, 1), [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]), (1, 1, 2005, datetime.date(2005, 1, 1), [(0.0, float(k)) for k in range(4)]), (2, 1, 2006, datetime.date(2006, 1, 1), [(0.0, 0.0)])]
    lines = spark.createDataFrame(rows, f"shoreline_id int, image_id int, year int, date date, vertices {LINE}")
    files.write_shorelines(lines, str(tmp_path / "deep/er/s.shp"), 26917)
    got = files.shapefiles(spark, str(tmp_path / "deep"), "Date string, year int, ImageId int").orderBy("year").collect()
    assert [(r["Date"], r["year"], len(r["vertices"]), r["epsg"]) for r in got] == [("2001/01/01", 2001, 3, 26917), ("2005/01/01", 2005, 4, 26917)]
    files.write_shorelines(lines, str(tmp_path / "other/s.shp"), 26917, "Day", "%Y-%m-%d")
    assert files.shapefiles(spark, str(tmp_path / "other"), "Day string").orderBy("Day").first()["Day"] == "2001-01-01"
    with pytest.raises(ValueError, match="two vertices"):
        files.write_shorelines(lines.where("year = 2006"), str(tmp_path / "none.shp"), 26917)
    base = spark.createDataFrame([(3, [(0.0, 0.0), (1.0, 0.0)]), (7, [(0.0, 0.0), (2.0, 0.0)])], f"Id int, vertices {LINE}")
    files.write_baseline(base, str(tmp_path / "base/b.shp"), 4326, "BID")
    assert sorted(r["BID"] for r in files.shapefiles(spark, str(tmp_path / "base"), "BID int").collect()) == [3, 7]


def test_geojson(spark, tmp_path):
    feature = lambda k, kind="LineString": {"type": "Feature", "properties": {"Id": k}, "geometry": {"type": kind, "coordinates": [[0, 1, 9], [2, 3, 9]]}}
    many = {"type": "Feature", "properties": {"Id": 4}, "geometry": {"type": "MultiLineString", "coordinates": [[[5, 6], [7, 8]], [[9, 9], [8, 8]]]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1), feature(2, "MultiPoint"), feature(3), many]}))
    got = files.geojson(spark, str(tmp_path / "a.geojson"), "Id: int").collect()
    assert [(r["Id"], [tuple(p) for p in r["vertices"]]) for r in got] == [(1, [(0, 1), (2, 3)]), (3, [(0, 1), (2, 3)]), (4, [(5, 6), (7, 8)]), (4, [(9, 9), (8, 8)])]


def test_listings(spark, tmp_path):
    for name in ("2020/123/a.png", "2020/123/b.PNG", "x/transect_1.shp", "x/base.shp", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    every = files.listing(spark, str(tmp_path))
    found = lambda df: sorted(r["name"] for r in df.collect())
    assert len(found(every)) == 5 and found(files.listing(spark, str(tmp_path), False)) == ["top.txt"]
    assert found(files.with_suffix(every, "PNG")) == ["b.PNG"] and found(files.holding(every)) == ["transect_1.shp"] and found(files.ending_in(every, ".shp")) == ["base.shp", "transect_1.shp"]
    assert sorted(r["folder"] for r in files.folders(every, str(tmp_path)).collect()) == ["2020", "2020/123", "x"]
    assert [r["folder"] for r in files.digit_folders(every, str(tmp_path)).collect()] == ["2020"]


def test_csv_and_readings(spark, tmp_path):
    (tmp_path / "w_1_x.csv").write_text("Date,Verified (m)\n2001/02/03,1.5\n2001-02-03,9\n")
    (tmp_path / "w_2_x.csv").write_text("Date,Other\n2002/01/01,4\n")
    assert files.csv_tables(spark, str(tmp_path), "nothing", "x.csv") is None
    both = files.csv_tables(spark, str(tmp_path), "w_", "x.csv", None)
    assert both.count() == 3 and set(both.columns) == {"Date", "Verified (m)", "Other"}
    got = files.readings(both).orderBy("file_pos").collect()
    assert [(r["Date"], r["verified_m"]) for r in got] == [(datetime.date(2001, 2, 3), 1.5), (datetime.date(2001, 2, 3), 9.0), (datetime.date(2002, 1, 1), None)]


def raster(shift):
    """Land west of a slanted coast with small bays."""
    y, x = np.mgrid[:420, :460]
    edge = 150 + y // 5 + 6 * (y // 30 % 2) + shift
    return codecs.write_tiff(codecs.Raster(np.where(x < edge, 180, 0).astype(np.uint8)[None], (2.0, 0.0, 350000.0, 0.0, -2.0, 4700000.0), 26916))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("images")
    for year, shift in ((1993, 0), (2001, 7), (2009, 15)):
        (at / f"4_{year}.tif").write_bytes(raster(shift))
    return str(at)


def test_folder_to_rates(spark, folder):
    out = composites.from_folder(spark, folder, Options(transect_length=120.0, transect_spacing=15.0))
    lines = out.shorelines.collect()
    assert sorted(r["year"] for r in lines) == [1993, 2001, 2009] and out.epsg == 26916
    for r in lines:
        assert all(350298 < p["x"] < 350530 and 4699160 <= p["y"] <= 4700000 for p in r["vertices"])
    base = out.baseline.collect()
    assert [r["Id"] for r in base] == list(range(len(base))) and {r["image_ord"] for r in base} == {0}
    n, found = out.transects.count(), out.intersections.count()
    assert n > 5 and abs(found - 3 * n) <= n
    signs = [np.sign(r["ChangeRate"]) for r in out.rates().collect()]
    assert max(signs.count(1), signs.count(-1)) > 0.8 * len(signs)
    similar = rates.frechet_rates(out.shorelines.withColumn("k", F.lit(1)), ["k"], F.col("year"), F.col("shoreline_id")).orderBy("year_start").collect()
    assert [(r["year_start"], r["year_end"]) for r in similar] == [(1993, 2001), (2001, 2009)] and all(r["rate"] == pytest.approx(r["distance"] / 8) for r in similar)
    again = composites.from_baseline(spark, folder, out.baseline.select("Id", "vertices"), Options(transect_length=120.0, transect_spacing=15.0))
    assert again.intersections.count() == found


def test_guards(spark, folder, tmp_path):
    (tmp_path / "1_2000.tif").write_bytes(raster(0))
    with pytest.raises(RuntimeError, match="Too few images"):
        composites.from_folder(spark, str(tmp_path))
    assert composites.from_image(spark, str(tmp_path / "1_2000.tif")).count() == 1
    (tmp_path / "2_2000.tif").write_bytes(codecs.write_tiff(codecs.Raster(np.ones((1, 9, 9), np.uint8), epsg=26917)))
    with pytest.raises(Exception, match="georeference"):
        composites.images(spark, str(tmp_path)).collect()


def test_archives(spark, tmp_path):
    bands = np.stack([np.full((25, 30), v, np.uint8) for v in (10, 20, 30, 40)])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("m_42_ne_16_1_20180101.tif", codecs.write_tiff(codecs.Raster(bands, (1.0, 0.0, 500000.0, 0.0, -1.0, 4649776.0), 26917)))
    (tmp_path / "m_42_ne_16_1_20180101.zip").write_bytes(buffer.getvalue())
    (tmp_path / "bad_1_2.ZIP").write_bytes(b"no archive")
    rows = composites.archive_tiles(spark, str(tmp_path), 10).collect()
    good = [r for r in rows if r["error"] is None]
    assert len(good) == 6 and all(bytes(r["bgr"]) == bytes((30, 20, 10)) * 100 for r in good) and {(r["site"], r["year"], r["infrared"]) for r in good} == {("42", "2018", True)}
    assert [r["name"] for r in rows if r["error"]] == ["bad_1_2.ZIP"] and good[0]["lon"] == pytest.approx(-81, abs=0.01) and good[0]["lat"] == pytest.approx(42, abs=0.01)
    infra = files.rasters(files.archive_members(files.read_bytes(spark, str(tmp_path), "m*.zip")).withColumn("path", F.col("member")), [4]).first()
    assert set(bytes(infra["pixels"])) == {40} and infra["n_bands"] == 1


def test_written_rasters_and_masks(spark, tmp_path):
    bands = np.arange(60, dtype=np.uint8).reshape(1, 6, 10)
    rows = files.rasters(spark.createDataFrame([("x", codecs.write_tiff(codecs.Raster(bands, (1.0, 0.0, 5.0, 0.0, -1.0, 6.0), 26916)))], "path string, content binary"))
    files.write_rasters(rows.withColumn("name", F.lit("sub/out.tif")), str(tmp_path))
    assert (codecs.read_tiff((tmp_path / "sub/out.tif").read_bytes()).bands == bands).all()
    masks = spark.createDataFrame([("m.png", 2, 2, bytes([0, 1, 1, 0]))], "name string, n_rows int, n_cols int, mask binary")
    files.write_masks(masks, str(tmp_path))
    assert codecs.read_png((tmp_path / "m.png").read_bytes()).tolist() == [[[0, 0, 0], [128, 0, 0]], [[128, 0, 0], [0, 0, 0]]]


def test_options():
    d = Options()
    assert (d.smooth_factor, d.transect_length, d.transect_spacing, d.edge_distance, d.least_factor, d.intersection_mode, d.transect_orientation) == (1, 500, 30, 100, 0.5, "closest", "mix")
    o = Options.from_json('{"options": {"smooth_factor": "3", "transect_length": "120.5", "intersection_mode": "farthest", "more": 1}}')
    assert (o.smooth_factor, o.transect_length, o.intersection_mode) == (3, 120.5, "farthest")
    assert Options.from_json({"edge_distance": 5}).edge_distance == 5 and Options.from_json({"shoreline_least_factor": "0.25"}).least_factor == 0.25
    with pytest.raises(ValueError, match="orientation"):
        Options.from_json({"transect_orientation": "up"})


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 5).alias("BaselineId"), F.col("o_custkey").alias("TransectId"), F.col("o_orderdate").alias("Date"), F.col("o_totalprice").alias("ref_dist"))
    source, schema = str(tmp_path / "in"), rows.schema
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = streaming_rates(stream).writeStream.format("memory").queryName("rates_so_far").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["TransectId"], r["n"], round(r["ChangeRate"], 3) if r["ChangeRate"] is not None else None) for r in df.collect())
    assert key(spark.table("rates_so_far")) == key(streaming_rates(rows))
