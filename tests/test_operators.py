"""Literal cases of the operators, and their edge cases."""

import datetime
import functools
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import crs, geometry, names
from tidemark.operators import profiles, rasters, rates, segmentation, shorelines, transects, waterlevels

LINE = "array<struct<x: double, y: double>>"
INF = float("inf")


def line(*points):
    return F.lit(0).isNotNull() if not points else F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def coupled(a, b):
    """Discrete distance by the recursion itself."""

    @functools.cache
    def least(i, j):
        before = [least(*p) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if min(p) >= 0]
        return max(math.dist(a[i], b[j]), min(before, default=0))

    return least(len(a) - 1, len(b) - 1)


def walk(seed, n):
    steps = np.random.default_rng(seed).normal(size=(n, 2)).round(3)
    return [tuple(p) for p in steps.cumsum(0).tolist()]


@pytest.mark.parametrize(("n", "m"), [(1, 1), (1, 6), (5, 2), (7, 7), (9, 4)])
def test_discrete_frechet(spark, n, m):
    a, b = walk(n, n), walk(50 + m, m)
    assert value(spark, geometry.discrete_frechet(line(*a), line(*b))) == pytest.approx(coupled(a, b))


def spaced(points, n):
    """n points at equal arc lengths."""
    steps = [math.dist(p, q) for p, q in itertools.pairwise(points)]
    at = np.concatenate([[0], np.cumsum(steps)])
    want = np.linspace(0, at[-1], n)
    return list(zip(*(np.interp(want, at, [p[k] for p in points]) for k in (0, 1)), strict=True))


@pytest.mark.parametrize(("n", "m"), [(3, 3), (4, 9), (8, 5)])
def test_modified_and_orientation_free_frechet(spark, n, m):
    a, b, k = walk(n, n), walk(70 + m, m), max(n, m)
    gaps = lambda p, q: [math.dist(x, y) for x, y in zip(spaced(p, k), spaced(q, k), strict=True)]
    spread = lambda d: max(d) - min(d)
    assert value(spark, geometry.modified_frechet(line(*a), line(*b))) == pytest.approx(spread(gaps(a, b)))
    assert value(spark, geometry.orientation_free_frechet(line(*a), line(*b))) == pytest.approx(min(spread(gaps(a, b)), spread(gaps(a[::-1], b))))
    assert value(spark, geometry.orientation_free_frechet(line(*a), line(*a[::-1]))) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize(("n", "m"), [(2, 6), (5, 3), (6, 20)])
def test_resample(spark, n, m):
    got = value(spark, geometry.resample(line(*walk(n, n)), m))
    assert np.allclose([tuple(p) for p in got], spaced(walk(n, n), m))


def test_resample_without_length_or_points(spark):
    assert [tuple(p) for p in value(spark, geometry.resample(line((2, 3), (2, 3)), 3))] == [(2, 3)] * 3
    for bad in (geometry.resample(line((0, 0)), 3), geometry.resample(line((0, 0), (1, 1)), 1)):
        with pytest.raises(Exception, match="resampling"):
            value(spark, bad)


def test_frechet_rates(spark):
    low, high = [(3.0 * k, 1.0) for k in range(6)], [(3.0 * k, 1.0 + k % 2) for k in range(6)]
    rows = spark.createDataFrame([("n", 1987, 0, high), ("n", 1982, 1, low), ("s", 1982, 2, low), ("s", 1982, 3, high), ("s", 1983, 4, high)], f"k string, year int, ord int, vertices {LINE}")
    got = sorted(tuple(r) for r in rates.frechet_rates(rows, ["k"], F.col("year"), F.col("ord")).collect())
    assert [(r[0], r[1], r[2]) for r in got] == [("n", 1982, 1987), ("s", 1982, 1983)]
    assert got[1][3:] == (0, 0) and got[0][4] == pytest.approx(got[0][3] / 5)


@pytest.mark.parametrize("two_sided", [False, True])
@pytest.mark.parametrize("values", [[20.0, 21.0, 19.5, 20.5, 40.0, 20.2, 19.9], [20.0, 21.0, 19.5, 20.5, 1.0, 20.2, 19.9], [7.25], [4.0, 4.0], []])
def test_outliers(spark, values, two_sided):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rates.flag_outliers(rows, "v", [], 2, two_sided).collect()
    mean, spread = (np.mean(values), np.std(values)) if values else (0, 0)
    far = [v for v in values if (abs(v - mean) if two_sided else v - mean) > 2 * spread]
    assert len(got) == len(values) and [r["v"] for r in got if r["outlier"]] == far


def rated(spark, *observations):
    rows = spark.createDataFrame([(1, t, d, k) for k, (t, d) in enumerate(observations)], "key int, t int, d double, k int")
    return rates.change_rates(rows, ["key"], F.col("t"), F.col("d"), F.col("k")).first()["ChangeRate"]


def test_rates(spark):
    assert rated(spark, (0, 1.0)) is None
    assert rated(spark, (0, 1.0), (4, 3.0)) == pytest.approx(0.5)
    assert math.isnan(rated(spark, (3, 1.0), (3, 1.0)))
    assert rated(spark, (3, 1.0), (3, 2.0)) == INF and rated(spark, (3, 2.0), (3, 1.0)) == -INF
    assert rated(spark, (3, 1.0), (3, 2.0), (3, 9.0)) == 0
    assert rated(spark, (0, 1.0), (1, 3.0), (2, 5.0)) == pytest.approx(2)
    assert rated(spark, (0, 1.0), (1, float("nan")), (2, 5.0)) is None


def test_calibration_cases(spark):
    t = spark.createDataFrame([(1, 1, 0.1, 5.0), (1, 1, 0.1, 5.0), (1, 2, 0.1, 5.0), (1, 3, 0.1, 5.0), (1, 4, 0.1, 5.0), (1, 5, 0.0, 5.0), (1, 6, 0.1, 5.0)], "BaselineId int, TransectId int, slope double, ChangeRate double")
    day = lambda y: datetime.date(y, 1, 1)
    found = [(1, 1, day(2000)), (1, 1, day(2001)), (1, 1, day(2002)), (1, 3, day(2001)), (1, 4, day(2001)), (1, 4, day(2001)), (1, 5, day(2000)), (1, 5, day(2001)), (1, 5, day(2002))] + [(1, 6, day(2001))] * 3
    i = spark.createDataFrame(found, "BaselineId int, TransectId int, Date date")
    levels = rates.levels_from(spark, {2000: 10.0, 2001: 11.0, 2002: 12.0})
    got = sorted((r["TransectId"], r["calibrated_rate"]) for r in rates.calibrate(t, i, levels).collect())
    assert got[:2] == [(1, pytest.approx(15.0))] * 2 and got[2] == (2, 5.0) and got[3] == (3, 5.0)
    assert math.isnan(got[4][1]) and got[5:] == [(5, 5.0), (6, 5.0)]
    assert [r["calibrated_rate"] for r in rates.calibrate(t.where("TransectId = 1"), i, levels, reference=0.0).collect()] == [pytest.approx(15.0)] * 2
    with pytest.raises(Exception, match="no water level"):
        rates.calibrate(t, i, levels.where("year < 2002")).collect()
    assert rates.calibrate(t, i, levels.where("year < 2002"), strict=False).count() == 7


def samples(elevs, dists):
    return profiles.profile(F.array(*(F.lit(float(d)) for d in dists)), F.array(*(F.lit(float(e)) for e in elevs)))


@pytest.mark.parametrize(
    ("elevs", "want"),
    [((0, 1, 2), [10, 10]), ((0, 1, 0), [10, 10]), ((0, 1, 1, 2), [10, 20]), ((1, 2), [0]), ((0, math.nan, 2, 0), [math.nan, math.nan, 25]), ((0, 0.5), [])],
)
def test_crossings(spark, elevs, want):
    got = value(spark, profiles.crossings(samples(elevs, [10 * k for k in range(len(elevs))]), 1.0))
    assert got == pytest.approx(want, nan_ok=True)


def test_refine_and_sentinels(spark):
    of = lambda *d: F.array(*(F.lit(float(x)) for x in d)) if d else F.expr("CAST(array() AS array<double>)")
    assert value(spark, profiles.refine(of(10, 20), F.lit(15.0))) == 10
    assert math.isnan(value(spark, profiles.refine(of(math.nan, 20), F.lit(15.0)))) and value(spark, profiles.refine(of(3, math.nan, 20), F.lit(15.0))) == 20
    assert value(spark, profiles.refine(of(), F.lit(15.0))) is None
    assert value(spark, profiles.compatible_crossings(of())) == [-999999] and value(spark, profiles.compatible_refined(profiles.refine(of(), F.lit(1.0)))) == -999


def test_beach_slope(spark):
    assert value(spark, profiles.beach_slope(samples([0, 1, 4, 5], [0, 10, 20, 30]), 10.0)) == pytest.approx(0.2)
    assert math.isnan(value(spark, profiles.beach_slope(samples([0, math.nan, math.inf], [0, 10, 20]), 10.0)))
    assert value(spark, profiles.beach_slope(samples([0, math.nan, 4], [0, 10, 20]), 10.0)) == pytest.approx(0.2)


def test_azimuth_and_days(spark):
    at = lambda *p: value(spark, geometry.azimuth(*(F.lit(float(x)) for x in p)))
    assert (at(0, 0, -1, 0), at(0, 0, 0, 1), at(2, 2, 2, 2)) == (270, 0, 0)
    assert value(spark, names.days_difference(F.lit("20200228"), F.lit("20200301"))) == 2 and value(spark, names.days_difference(F.lit("20200301"), F.lit("20200228"))) == -2


def test_extents(spark):
    box = lambda *v: dict(zip(("xmin", "xmax", "ymin", "ymax"), map(F.lit, (v[0], v[2], v[1], v[3])), strict=True))
    assert value(spark, geometry.overlaid(box(0, 0, 10, 10), box(5, 5, 15, 15))) and not value(spark, geometry.overlaid(box(0, 0, 10, 10), box(20, 20, 30, 30)))
    assert [value(spark, geometry.within(F.lit(x), F.lit(y), box(0, 0, 10, 10))) for x, y in ((5, 5), (-1, 5), (5, 11), (10, 10))] == [True, False, False, True]


def test_names(spark):
    stem = names.stem(F.lit("/a.b/7_2003.tif"))
    assert (value(spark, names.year_of(stem)), value(spark, names.id_of(stem)), value(spark, names.date_of(names.year_of(stem)))) == (2003, 7, datetime.date(2003, 1, 1))
    with pytest.raises(Exception, match="no year"):
        value(spark, names.year_of(F.lit("no_year")))
    assert names.date_pattern("%Y/%m/%d") == "yyyy/MM/dd" and names.date_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    assert value(spark, names.archive_site(F.lit("m_4208_ne_16_1_20180101.zip"))) == "4208" and value(spark, names.archive_year(F.lit("m_4208_ne_16_1_20180101.zip"))) == "2018"


def test_crs(spark):
    lon, lat = crs.to_lonlat(F.lit(500000.0), F.lit(4649776.22482), 17)
    assert (value(spark, lon), value(spark, lat)) == pytest.approx((-81.0, 42.0), abs=1e-7)
    x, y = crs.reproject(F.lit(-87.25), F.lit(41.75), 4326, 26916)
    back = crs.reproject(x, y, 26916, 4326)
    assert (value(spark, back[0]), value(spark, back[1])) == pytest.approx((-87.25, 41.75), abs=1e-10)
    east, north = crs.reproject(F.lit(151.2), F.lit(-33.85), 4326, 32756)
    assert 3e5 < value(spark, east) < 4e5 and 6.2e6 < value(spark, north) < 6.3e6
    mirrored = crs.reproject(F.lit(151.2), F.lit(33.85), 4326, 32656)
    assert value(spark, mirrored[1] + north) == pytest.approx(1e7) and value(spark, mirrored[0]) == pytest.approx(value(spark, east))
    assert value(spark, crs.reproject(east, north, 32756, 4326)[1]) == pytest.approx(-33.85, abs=1e-10)
    with pytest.raises(ValueError, match="not supported"):
        crs.reproject(F.lit(0.0), F.lit(0.0), 3857, 4326)


def test_water_tables(spark):
    rows = spark.createDataFrame([("2001-02-01", 1.0), ("2001-05-01", 3.0), ("2004-01-01", 7.0), (None, 9.0)], "d string, v double")
    got = {r["year"]: r["level"] for r in waterlevels.yearly_means(rows, F.to_date("d"), F.col("v")).collect()}
    assert got == {2001: 2.0, 2002: None, 2003: None, 2004: 7.0}
    files = spark.createDataFrame([(f"f{k:02d}",) for k in range(41)], "path string")
    got = {r["path"]: r["batch"] for r in waterlevels.batches(files).collect()}
    assert got["f40"] == 0 and got["f21"] == 0 and got["f20"] == 1 and got["f00"] == 2


def test_runs_ids_and_lengths(spark):
    marks = {0: "..E..E", 1: "....", 2: "E...EE.", 3: "E"}
    rows = [(0, c, p, float(p), 0.0, m == "E") for c, text in marks.items() for p, m in enumerate(text)]
    v = spark.createDataFrame(rows, "image_ord int, contour_id int, pos int, x double, y double, edge boolean")
    got = sorted((r["contour_id"], r["shoreline_id"], r["n"]) for r in shorelines.shoreline_ids(v, ["image_ord"], "contour_id", "pos").collect())
    # an id at each contour's start, another after each line that an edge vertex ends
    assert got == [(0, 0, 2), (0, 1, 2), (1, 3, 4), (2, 4, 3), (2, 5, 1)]
    assert {r["contour_id"] for r in shorelines.open_contours(v, ["image_ord", "contour_id"]).collect()} == {0, 2, 3}
    long = spark.createDataFrame([(0, n) for n in (5, 2, 1)], "image_ord int, n int")
    assert sorted(r["n"] for r in shorelines.long_lines(long, ["image_ord"]).collect()) == [2, 5]


def test_baseline_bridges_gaps(spark):
    rows = [(0, 0, p, float(p), 0.0) for p in range(3)] + [(1, 5, p, x, 0.0) for p, x in enumerate((5.0, 1.0, 6.0))] + [(1, 6, 0, 1.0, 0.0)]
    v = spark.createDataFrame(rows, "image_ord int, shoreline_id int, pos int, x double, y double")
    e = spark.createDataFrame([(0, 0.0, 2.0, 0.0, 0.0), (1, 0.0, 9.0, 0.0, 0.0)], "image_ord int, xmin double, xmax double, ymin double, ymax double")
    got = sorted((r["Id"], [p["x"] for p in r["vertices"]]) for r in shorelines.baseline(v, e).collect())
    assert got == [(0, [0.0, 1.0, 2.0]), (1, [5.0, 6.0])]


def test_tiles_round_trip(spark):
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 99, 6 * 9).tolist()
    image = spark.createDataFrame([(1, 6, 9, cells)], "k int, n_rows int, n_cols int, cells array<int>")
    tiles = rasters.cut(image, ["k"], 3, keep_rest=True)
    assert rasters.assemble(tiles, ["k"]).first()["cells"] == cells
    with pytest.raises(Exception, match="missing"):
        rasters.assemble(tiles.where("tile_row <> 0 OR tile_col <> 1"), ["k"]).collect()
    grid = lambda h, w, keep: [tuple(t)[2:] for t in value(spark, rasters.tile_grid(F.lit(h), F.lit(w), 1000, keep))]
    assert grid(2500, 1999, False) == [(0, 0, 1000, 1000), (1000, 0, 1000, 1000)] and grid(2500, 1999, True) == [(0, 0, 1000, 1999), (1000, 0, 1500, 1999)] and grid(999, 5000, True) == []


def test_borders():
    square = np.zeros((8, 9), np.uint8)
    square[2:6, 3:7] = 1
    assert rasters.follow_borders(square) == [(False, [(3, 2), (3, 5), (6, 5), (6, 2)])]
    square[3:5, 4:6] = 0
    (outer, points), (hole, inner) = rasters.follow_borders(square)
    assert (outer, hole) == (False, True) and len(points) == 4 and set(inner) >= {(3, 3), (4, 2)}
    dot = np.zeros((3, 3), np.uint8)
    dot[1, 1] = 1
    assert rasters.follow_borders(dot) == [(False, [(1, 1)])]
    assert rasters.follow_borders(np.zeros((3, 3), np.uint8)) == []
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = (rng.random((12, 14)) < 0.5).astype(np.uint8)
        found = rasters.follow_borders(mask)
        assert sum(not h for h, _ in found) == regions(mask, 8)
        framed = np.pad(1 - mask, 1, constant_values=1)
        assert sum(h for h, _ in found) == regions(framed, 4) - 1
        assert all(mask[y, x] for _, line in found for x, y in line)


def regions(mask, near):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (near == 8)
    left, n = {tuple(p) for p in np.argwhere(mask)}, 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                if (r + dr, c + dc) in left:
                    left.remove((r + dr, c + dc))
                    todo.append((r + dr, c + dc))
    return n


@pytest.mark.parametrize("shape", [(340, 190), (900, 700), (130, 1900)])
def test_segmentation_keeps_size(shape):
    seen = []

    def model(x):
        seen.append(x.shape)
        return np.concatenate([np.zeros_like(x[:, :1]), x[:, :1]], 1)[:, :, ::8, ::8]

    picture = np.random.default_rng(0).integers(0, 256, (*shape, 3), np.uint8)
    mask = segmentation.predict(model, picture)
    assert mask.shape == shape and set(np.unique(mask)) <= {0, 1} and min(seen[0][2:]) >= 512
    assert {tuple(c) for c in segmentation.colours(mask).reshape(-1, 3)} <= {(0, 0, 0), (0, 0, 128)}


def test_cast_and_intersect(spark):
    base = spark.createDataFrame([(4, [(0.0, 0.0), (100.0, 0.0)])], f"Id int, vertices {LINE}")
    t = transects.cast(base, length=40.0, spacing=25.0)
    assert sorted((r["TransectId"], r["x0"], r["y0"], r["y1"]) for r in t.collect()) == [(k, 25.0 * k, -20.0, 20.0) for k in range(5)]
    shore = [(datetime.date(2000, 1, 1), 1, [(-5.0, 5.0), (60.0, 5.0), (60.0, -9.0), (-5.0, -9.0)]), (datetime.date(2010, 1, 1), 2, [(-5.0, 15.0), (105.0, 15.0)])]
    s = spark.createDataFrame(shore, f"Date date, ImageId int, vertices {LINE}")
    near = {(r["TransectId"], r["ImageId"]): r["ref_dist"] for r in transects.intersect(t, s, 40.0).collect()}
    assert near == {(0, 1): 5, (1, 1): 5, (2, 1): 5, **{(k, 2): 15 for k in range(5)}}
    assert transects.intersect(t, s, 40.0, "farthest").where("ImageId = 1").first()["ref_dist"] == -9
    got = {r["TransectId"]: r["ChangeRate"] for r in transects.transect_rates(transects.intersect(t, s, 40.0)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0}
    assert transects.cast(base, length=40.0, spacing=25.0, orientation="left").first()["y1"] == 40
    with pytest.raises(ValueError, match="orientation"):
        transects.cast(base, orientation="up")
