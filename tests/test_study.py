"""Whole studies with a stand-in model: archives to rates, folders of pictures, merged layers."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import composites, study
from tidemark.sources import codecs, files
from tidemark.sources.options import Options

LINE = "array<struct<x: double, y: double>>"
X, Y, SIDE, TILE = 400000.0, 4800000.0, 240, 80


@pytest.fixture
def make_model():
    """Two classes: bright cells are water. Made inside a function, so that workers need not import this file."""

    def make():
        return lambda data: np.concatenate([-data[:, :1], data[:, :1]], 1)

    return make


@pytest.fixture
def config(make_model):
    return composites.Config(make_model=make_model, transect_spacing=20.0, transect_length=100.0)


def quadrant(row, col, shift):
    """A part of a coast: bright in the west."""
    y, x = np.mgrid[row * SIDE : (row + 1) * SIDE, col * SIDE : (col + 1) * SIDE]
    return np.repeat(np.where(x < 200 + y // 6 + shift, 250, 5).astype(np.uint8)[None], 3, 0)


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    for year, shift in ((2004, 0), (2012, 9)):
        for direction, row, col in (("nw", 0, 0), ("ne", 0, 1), ("sw", 1, 0), ("se", 1, 1)):
            name = f"q_31_{direction}_16_{year}0601"
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr(name + ".tif", codecs.write_tiff(codecs.Raster(quadrant(row, col, shift), (1.0, 0.0, X + col * SIDE, 0.0, -1.0, Y - row * SIDE), 26916)))
            (at / (name + ".zip")).write_bytes(held.getvalue())
    return str(at)


def test_archives_to_layers(spark, archives, tmp_path, config):
    result = study.process_folder(spark, archives, str(tmp_path), config, Options(transect_length=100.0, transect_spacing=20.0, edge_distance=5), TILE, keep_masks=True)
    for year, shift in ((2004, 0), (2012, 9)):
        got = codecs.read_tiff((tmp_path / f"Final_Folder/31/31_{year}.tif").read_bytes())
        whole = np.concatenate([np.concatenate([quadrant(r, c, shift)[0] for c in (0, 1)], 1) for r in (0, 1)])
        assert got.epsg == 26916 and got.transform == (1.0, 0.0, X, 0.0, -1.0, Y) and got.bands.shape == (3, 2 * SIDE, 2 * SIDE)
        assert ((got.bands[0] == 128) == (whole > 100)).mean() > 0.99 and not got.bands[1:].any()
    assert len(list((tmp_path / "binary_map/2004/31").iterdir())) == 4 * (SIDE // TILE) ** 2
    layer = lambda name, record: files.shapefiles(spark, str(tmp_path / "Result"), record).where(F.col("path").endswith(f"/{name}.shp"))
    assert sorted(r["year"] for r in layer("shoreline", "year int").collect()) == [2004, 2012]
    n = layer("transect", "TransectId int").count()
    assert n == result.transects.count() > 5 and layer("baseline", "Id int").count() >= 1
    found = spark.read.parquet(str(tmp_path / "Result/intersection"))
    assert abs(found.count() - 2 * n) <= n
    rates = [r["ChangeRate"] for r in result.rates().where("n = 2").collect()]
    assert abs(abs(np.median(rates)) - 9 / 8) < 0.2


def test_no_model(spark, archives, tmp_path):
    with pytest.raises(ValueError, match="model"):
        study.process_folder(spark, archives, str(tmp_path), composites.Config())


def test_quadrants_and_mosaics(spark):
    def tile(name, x, value, site="7", a=1.0):
        return (site, "2010", name, 26916, (a, 0.0, x, 0.0, -1.0, 50.0), 0, 0, 2, 3, bytes([value] * 6))

    schema = f"site string, year string, name string, epsg int, transform {files.TRANSFORM}, row0 int, col0 int, n_rows int, n_cols int, mask binary"
    tiles = spark.createDataFrame([tile("a_se.tif", 0.0, 1), tile("b_se.tif", 9.0, 1), tile("c_nw.tif", 2.0, 0), tile("d.tif", 0.0, 1)], schema)
    kept = study.quadrants(tiles)
    assert sorted(r["name"] for r in kept.collect()) == ["a_se.tif", "c_nw.tif"]
    (row,) = study.mosaics(kept).collect()
    assert (row["name"], row["n_rows"], row["n_cols"], row["transform"]["c"]) == ("7/7_2010.tif", 2, 5, 0.0)
    assert np.frombuffer(bytes(row["pixels"]), np.uint8).reshape(3, 2, 5)[0].tolist() == [[128, 128, 128, 0, 0]] * 2
    with pytest.raises(Exception, match="cell sizes"):
        study.mosaics(spark.createDataFrame([tile("a", 0.0, 1), tile("b", 0.0, 1, a=2.0)], schema)).collect()
    assert study.mosaics(tiles.limit(0)).count() == 0


def test_segment_folder_and_file(spark, tmp_path, make_model):
    image = np.zeros((40, 60, 3), np.uint8)
    image[:, :25] = 250
    for place in ("flat/p.png", "deep/2001/4/r_0.png", "deep/2002/5/r_1.png"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(codecs.write_png(image))
    study.segment_folder(spark, str(tmp_path / "flat"), str(tmp_path / "out"), make_model)
    study.segment_folder(spark, str(tmp_path / "deep"), str(tmp_path / "out"), make_model)
    study.segment_file(spark, str(tmp_path / "flat/p.png"), str(tmp_path / "out/one.png"), make_model)
    for place in ("p.png", "2001/4/r_0.png", "2002/5/r_1.png", "one.png"):
        got = codecs.read_png((tmp_path / "out" / place).read_bytes())
        assert got.shape == (40, 60, 3) and ((got[:, :, 0] == 128) == (image[:, :, 0] > 100)).mean() > 0.95
    (tmp_path / "flat/bad.png").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no readable picture"):
        study.segment_folder(spark, str(tmp_path / "flat"), str(tmp_path / "out"), make_model)


def test_process_image(spark, tmp_path, config):
    path = tmp_path / "3_2007.tif"
    path.write_bytes(codecs.write_tiff(codecs.Raster(np.where(quadrant(0, 0, -80) > 100, 250, 0).astype(np.uint8), (1.0, 0.0, X, 0.0, -1.0, Y), 26916)))
    lines = study.process_image(spark, str(path), str(tmp_path / "out"), config, Options(edge_distance=5))
    assert lines.count() == 1 and codecs.read_png((tmp_path / "out/output.png").read_bytes()).shape == (SIDE, SIDE, 3)
    assert files.shapefiles(spark, str(tmp_path / "out"), "year int").first()["year"] == 2007


def test_merge_layers(spark, tmp_path):
    one = spark.createDataFrame([(1, [(500000.0, 4700000.0), (500010.0, 4700000.0)])], f"Id int, vertices {LINE}")
    files.write_baseline(one, str(tmp_path / "a/x.shp"), 26917)
    files.write_baseline(one.select("Id", F.expr(f"CAST(array(named_struct('x', -81D, 'y', 42.0D), named_struct('x', -81D, 'y', 42.1D)) AS {LINE}) AS vertices")), str(tmp_path / "b/y.shp"), 4326)
    got = {r["folder"][-1]: r["vertices"] for r in study.merge_layers(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "Id int", 26917).collect()}
    assert got["a"][0]["x"] == 500000.0 and got["b"][0]["x"] == pytest.approx(500000, abs=0.01)
    with pytest.raises(ValueError, match="folders"):
        study.merge_layers(spark, [], "Id int")
