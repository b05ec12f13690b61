"""The registered shoreline queries, each with the SQL it is checked against. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import crs, geometry, names
from tidemark.operators import profiles, rasters, rates, shorelines, transects, waterlevels
from tidemark.plans import views
from tidemark.plans.views import Tables, sql_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = ["BaselineId", "TransectId"]
CELL = 120.0


def query(sql: str | None = None):
    """Register a function of the tables under its name, with its SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def number(c: Column) -> Column:
    """Rounded; not a number as null."""
    return F.when(~F.isnan(c), r6(c))


# Rates and calibration

_STATS = "count(*) AS n, var_pop(t) AS v, covar_pop(d, t) AS c"
_SLOPE = "CASE WHEN n < 2 THEN 0 WHEN v = 0 THEN (CASE WHEN n = 2 THEN NULL ELSE 0 END) ELSE c / v END"


def rated_transects(t: Tables) -> DataFrame:
    """Transects with the rate of their intersections, 0 where it has none."""
    found = rates.change_rates(views.intersections(t), KEYS, F.year("Date"), F.col("ref_dist"), F.struct("Date", "o_orderkey"))
    held = views.transects(t).join(found.drop("n"), KEYS, "left")
    plain = F.when(F.isnan("ChangeRate") | (F.abs("ChangeRate") == float("inf")), 0.0).otherwise(F.coalesce("ChangeRate", F.lit(0.0)))
    return held.withColumn("ChangeRate", plain)


_RATED = f"""og AS (SELECT BaselineId, TransectId, y - min(y) OVER (PARTITION BY TransectId) AS t, ref_dist AS d FROM ix),
ra AS (SELECT TransectId, {_STATS} FROM og GROUP BY 1),
rt AS (SELECT tr.*, coalesce(CASE WHEN n < 2 OR v = 0 THEN 0 ELSE c / v END, 0) AS ChangeRate FROM tr LEFT JOIN ra USING (TransectId))"""


@query(f"""{sql_with("tr", "ix", "wl")}, {_RATED},
pg AS (SELECT ix.TransectId, y - min(y) OVER (PARTITION BY ix.TransectId) AS t, -(level - (SELECT avg(level) FROM wl)) / slope AS d
  FROM ix JOIN tr USING (TransectId) JOIN wl ON year = y),
pa AS (SELECT TransectId, {_STATS} FROM pg GROUP BY 1)
SELECT BaselineId, TransectId, round(slope, 6) AS slope, round(ChangeRate, 6) AS ChangeRate,
  round(ChangeRate - (CASE WHEN n IS NULL THEN 0 ELSE {_SLOPE} END), 6) AS calibrated_rate
FROM rt LEFT JOIN pa USING (TransectId)""")
def q_calibrate_water_level(t: Tables) -> DataFrame:
    found = rates.calibrate(rated_transects(t), views.intersections(t), views.levels(t))
    return found.select(*KEYS, r6("slope").alias("slope"), r6("ChangeRate").alias("ChangeRate"), number(F.col("calibrated_rate")).alias("calibrated_rate"))


@query(f"""{sql_with("ix")}, g AS (SELECT BaselineId, TransectId, y - 1990 AS t, ref_dist AS d FROM ix),
a AS (SELECT BaselineId, TransectId, {_STATS} FROM g GROUP BY ALL)
SELECT BaselineId, TransectId, n, round(CASE WHEN n < 2 THEN NULL ELSE {_SLOPE} END, 6) AS ChangeRate FROM a""")
def q_change_rate(t: Tables) -> DataFrame:
    found = rates.change_rates(views.intersections(t), KEYS, F.year("Date") - 1990, F.col("ref_dist"), F.struct("Date", "o_orderkey"))
    return found.select(*KEYS, "n", F.when(F.abs("ChangeRate") != float("inf"), number(F.col("ChangeRate"))).alias("ChangeRate"))


@query(f"""{sql_with("ix")}, k AS (SELECT *, row_number() OVER (PARTITION BY TransectId ORDER BY Date, o_orderkey) AS rn FROM ix),
p AS (SELECT BaselineId, TransectId, count(*) AS n, arg_min(y, rn) AS y0, arg_max(y, rn) AS y1, arg_min(ref_dist, rn) AS d0, arg_max(ref_dist, rn) AS d1 FROM k WHERE rn <= 2 GROUP BY ALL)
SELECT BaselineId, TransectId, n, CASE WHEN n < 2 THEN NULL WHEN y1 > y0 THEN round((d1 - d0) / (y1 - y0), 6) END AS ChangeRate,
  n = 2 AND y1 = y0 AND d1 <> d0 AS infinite FROM p""")
def q_rate_two_point(t: Tables) -> DataFrame:
    rows = transects.numbered(views.intersections(t), KEYS, ["Date", "o_orderkey"], "k").where("k < 2")
    found = rates.change_rates(rows, KEYS, F.year("Date"), F.col("ref_dist"), F.struct("Date", "o_orderkey"))
    infinite = F.coalesce(F.abs("ChangeRate") == float("inf"), F.lit(False))
    return found.select(*KEYS, "n", F.when(~infinite, number(F.col("ChangeRate"))).alias("ChangeRate"), infinite.alias("infinite"))


@query(f"""{sql_with("ix")}, f AS (SELECT *, min(y) OVER (PARTITION BY TransectId) AS y0 FROM ix),
a AS (SELECT BaselineId, TransectId, count(*) AS n, count(DISTINCT ref_dist) AS k FROM f WHERE y = y0 GROUP BY ALL)
SELECT BaselineId, TransectId, n, CASE WHEN n > 2 THEN 'zero' WHEN n < 2 THEN 'none' WHEN k = 1 THEN 'nan' ELSE 'infinite' END AS kind FROM a""")
def q_rate_degenerate(t: Tables) -> DataFrame:
    rows = views.intersections(t)
    first = rows.groupBy(*KEYS).agg(F.min(F.year("Date")).alias("y0"))
    rows = rows.join(first, KEYS).where(F.year("Date") == F.col("y0"))
    found = rates.change_rates(rows, KEYS, F.year("Date"), F.col("ref_dist"), F.struct("Date", "o_orderkey"))
    r = F.col("ChangeRate")
    return found.select(*KEYS, "n", F.when(r.isNull(), "none").when(F.isnan(r), "nan").when(F.abs(r) == float("inf"), "infinite").otherwise("zero").alias("kind"))


@query(f"{sql_with('wl')} SELECT round(avg(level), 6) AS reference, count(*) AS years FROM wl")
def q_reference_level(t: Tables) -> DataFrame:
    return views.levels(t).agg(r6(F.avg("level")).alias("reference"), F.count(F.lit(1)).alias("years"))


@query(f"""{sql_with("tr", "ix", "wl")} SELECT o_orderkey, TransectId, y AS year, round(-(level - (SELECT avg(level) FROM wl)) / slope, 6) AS shift
FROM ix JOIN tr USING (TransectId) JOIN wl ON year = y""")
def q_predicted_shift(t: Tables) -> DataFrame:
    levels = views.levels(t)
    rows = rates.with_levels(views.intersections(t), levels, F.year("Date")).join(views.transects(t), KEYS)
    return rows.select("o_orderkey", "TransectId", F.year("Date").alias("year"), r6(rates.predicted_shift(F.col("level"), rates.reference_level(levels), F.col("slope"))).alias("shift"))


@query(f"{sql_with('tr')} SELECT BaselineId, TransectId, round(slope, 6) AS slope FROM tr WHERE BaselineId = 5")
def q_transect_select(t: Tables) -> DataFrame:
    return transects.select_transects(views.transects(t), {"BaselineId": 5, "TransectId": None}).select(*KEYS, r6("slope").alias("slope"))


def _outliers(two_sided: bool) -> str:
    away = "abs(value - m)" if two_sided else "value - m"
    return f"""WITH g AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT event_id, coalesce(n >= 2 AND s > 0 AND {away} > 3 * s, false) AS outlier FROM events JOIN g USING (event_type)"""


@query(_outliers(False))
def q_flag_outliers_one(t: Tables) -> DataFrame:
    return rates.flag_outliers(t.events.select("event_id", "event_type", "value"), "value", ["event_type"]).select("event_id", "outlier")


@query(_outliers(True).replace("> 3 * s", "> 1.5e0 * s"))
def q_flag_outliers_two_sided(t: Tables) -> DataFrame:
    return rates.flag_outliers(t.events.select("event_id", "event_type", "value"), "value", ["event_type"], 1.5, True).select("event_id", "outlier")


# Similarity of lines


def line_pairs(t: Tables) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = views.lines(t).select("label", "vec_id", "vertices", F.lead("vec_id").over(w).alias("b"), F.lead("vertices").over(w).alias("other")).where("b IS NOT NULL")
    return rows.select("label", F.col("vec_id").alias("a"), "b", "vertices", "other")


@query(f"""{sql_with("pv", "pr", recursive=True)},
ls AS (SELECT vec_id, list(x ORDER BY pos) AS x, list(y ORDER BY pos) AS y FROM pv GROUP BY 1),
st AS (SELECT a, b, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS bz FROM pr JOIN ls p ON p.vec_id = a JOIN ls q ON q.vec_id = b),
rc AS (
  SELECT a, b, ax, ay, bx, bz, 0 AS k, list_concat([1e300 FOR i IN range(32)], [sqrt((ax[1] - bx[1]) ** 2 + (ay[1] - bz[1]) ** 2)]) AS s FROM st
  UNION ALL
  SELECT a, b, ax, ay, bx, bz, k + 1, list_append(s[2:33], greatest(
    sqrt((ax[(k + 1) // 32 + 1] - bx[(k + 1) % 32 + 1]) ** 2 + (ay[(k + 1) // 32 + 1] - bz[(k + 1) % 32 + 1]) ** 2),
    least(s[2], CASE WHEN (k + 1) % 32 = 0 THEN 1e300 ELSE least(s[1], s[33]) END))) FROM rc WHERE k < 1023)
SELECT a, b, round(s[33], 6) AS distance FROM rc WHERE k = 1023""")
def q_frechet_discrete(t: Tables) -> DataFrame:
    return line_pairs(t).select("a", "b", r6(geometry.discrete_frechet(F.col("vertices"), F.col("other"))).alias("distance"))


def _resampled(n: int, source: str = "pv", key: str = "vec_id") -> str:
    """CTEs that end in rs(key, k, x, y): n points by arc length."""
    return f"""sg AS (SELECT {key}, pos, x, y, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
cu AS (SELECT *, sum(d) OVER (PARTITION BY {key} ORDER BY pos) AS s, lag(x) OVER w AS px, lag(y) OVER w AS py FROM sg WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
tt AS (SELECT {key}, max(s) AS total, max(pos) AS last FROM cu GROUP BY 1),
tg AS (SELECT {key}, k, k * total / ({n} - 1) AS target, last FROM tt, range({n}) AS r(k)),
hit AS (SELECT {key}, k, target, coalesce((SELECT min(pos) FROM cu c WHERE c.{key} = tg.{key} AND c.pos >= 1 AND c.s >= target), last) AS pos FROM tg),
rs AS (SELECT {key}, k, CASE WHEN k = 0 THEN (SELECT x FROM {source} z WHERE z.{key} = hit.{key} AND z.pos = 0) WHEN k = {n} - 1 THEN (SELECT x FROM {source} z WHERE z.{key} = hit.{key} AND z.pos = last2) ELSE px + (target - (s - d)) / d * (x - px) END AS x,
  CASE WHEN k = 0 THEN (SELECT y FROM {source} z WHERE z.{key} = hit.{key} AND z.pos = 0) WHEN k = {n} - 1 THEN (SELECT y FROM {source} z WHERE z.{key} = hit.{key} AND z.pos = last2) ELSE py + (target - (s - d)) / d * (y - py) END AS y
  FROM (SELECT hit.*, c.px, c.py, c.x, c.y, c.s, c.d, tt.last AS last2 FROM hit JOIN cu c USING ({key}, pos) JOIN tt USING ({key})) hit)"""


_GAPS = """ga AS (SELECT a, b, max(g) - min(g) AS m, max(h) - min(h) AS mr FROM (
  SELECT a, b, p.k, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS g, sqrt((o.x - q.x) ** 2 + (o.y - q.y) ** 2) AS h
  FROM pr JOIN rs p ON p.vec_id = a JOIN rs q ON q.vec_id = b AND q.k = p.k JOIN rs o ON o.vec_id = a AND o.k = 31 - p.k) GROUP BY 1, 2)"""


@query(f"{sql_with('pv', 'pr')}, {_resampled(32)}, {_GAPS} SELECT a, b, round(m, 6) AS distance FROM ga")
def q_frechet_modified(t: Tables) -> DataFrame:
    return line_pairs(t).select("a", "b", r6(geometry.modified_frechet(F.col("vertices"), F.col("other"))).alias("distance"))


@query(f"{sql_with('pv', 'pr')}, {_resampled(32)}, {_GAPS} SELECT a, b, round(least(m, mr), 6) AS distance FROM ga")
def q_frechet_orientation_free(t: Tables) -> DataFrame:
    return line_pairs(t).select("a", "b", r6(geometry.orientation_free_frechet(F.col("vertices"), F.col("other"))).alias("distance"))


@query(f"""{sql_with("pv")}, pr AS (SELECT label, a, b FROM (SELECT label, vec_id AS a, lead(vec_id) OVER w AS b, vec_id // 40 AS u, lead(vec_id // 40) OVER w AS v
  FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id // 40, vec_id)) WHERE u <> v), {_resampled(32)}, {_GAPS}
SELECT label, 2000e0 + a // 40 AS year_start, 2000e0 + b // 40 AS year_end, round(least(m, mr), 6) AS distance, round(least(m, mr) / (b // 40 - a // 40), 6) AS rate FROM ga JOIN pr USING (a, b)""")
def q_frechet_rates(t: Tables) -> DataFrame:
    lines = views.lines(t).withColumn("year", 2000 + F.floor(F.col("vec_id") / 40))
    found = rates.frechet_rates(lines, ["label"], F.col("year"), F.col("vec_id"))
    return found.select("label", "year_start", "year_end", r6("distance").alias("distance"), r6("rate").alias("rate"))


@query(f"{sql_with('pv')}, {_resampled(17)} SELECT vec_id, k AS pos, round(x, 6) AS x, round(y, 6) AS y FROM rs")
def q_resample(t: Tables) -> DataFrame:
    rows = views.lines(t).select("vec_id", F.posexplode(geometry.resample(F.col("vertices"), 17)).alias("pos", "p"))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6("p.x").alias("x"), r6("p.y").alias("y"))


# Shorelines

_RUNS = """rn AS (SELECT *, sum(edge::INT) OVER (PARTITION BY contour_id ORDER BY pos) AS run FROM ce),
ru AS (SELECT image_ord, contour_id, run, count(*) AS n, min(pos) AS first_pos, sum(x) AS sx FROM rn WHERE NOT edge GROUP BY ALL)"""


def runs(t: Tables) -> DataFrame:
    rows = shorelines.edge_runs(views.contour_vertices(t), ["image_ord"], "contour_id", "pos")
    return rows.groupBy("image_ord", "contour_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.sum("x").alias("sx"))


@query(f"{sql_with('cv', 'ce')}, {_RUNS} SELECT image_ord, contour_id, run::BIGINT AS run, n, first_pos, round(sx, 6) AS sum_x FROM ru")
def q_edge_islands(t: Tables) -> DataFrame:
    return runs(t).select("image_ord", "contour_id", "run", "n", "first_pos", r6("sx").alias("sum_x"))


@query(f"""{sql_with('cv', 'ce')}, {_RUNS} SELECT image_ord, contour_id, run::BIGINT AS run, n FROM ru
WHERE n >= floor(0.5e0 * (SELECT max(n) FROM ru z WHERE z.image_ord = ru.image_ord))""")
def q_length_filter(t: Tables) -> DataFrame:
    return shorelines.long_lines(runs(t), ["image_ord"]).select("image_ord", "contour_id", "run", "n")


@query(f"""{sql_with('cv')}, ce AS (SELECT *, x <= 1 OR y <= 1 OR x >= 399 OR y >= 400 AS edge FROM cv)
SELECT image_ord, contour_id, count(*) AS n, count(*) FILTER (WHERE edge) AS n_edge FROM ce GROUP BY ALL HAVING bool_or(edge)""")
def q_closure_filter(t: Tables) -> DataFrame:
    rows = shorelines.open_contours(views.contour_vertices(t, 1), ["image_ord", "contour_id"])
    return rows.groupBy("image_ord", "contour_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("n_edge"))


@query(f"""{sql_with('cv', 'ce')},
mk AS (SELECT *, sum(edge::INT) OVER (PARTITION BY contour_id ORDER BY pos) AS run, edge AND NOT coalesce(lag(edge) OVER (PARTITION BY contour_id ORDER BY pos), true) AS flush FROM ce),
gl AS (SELECT *, sum(flush::INT) OVER (PARTITION BY image_ord ORDER BY contour_id, pos) AS flushes, dense_rank() OVER (PARTITION BY image_ord ORDER BY contour_id) AS contours FROM mk)
SELECT image_ord, contour_id, (max(flushes) + max(contours) - 1)::BIGINT AS shoreline_id, count(*) AS n, round(sum(x), 6) AS sum_x FROM gl WHERE NOT edge GROUP BY image_ord, contour_id, run""")
def q_shoreline_ids(t: Tables) -> DataFrame:
    rows = shorelines.shoreline_ids(views.contour_vertices(t), ["image_ord"], "contour_id", "pos")
    total = F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v["x"])
    return rows.select("image_ord", "contour_id", "shoreline_id", "n", r6(total).alias("sum_x"))


_KEPT = "kp AS (SELECT * FROM iv WHERE NOT EXISTS (SELECT 1 FROM ext WHERE ext.image_ord < iv.image_ord AND iv.x BETWEEN xmin AND xmax AND iv.y BETWEEN ymin AND ymax))"


@query(f"""{sql_with('pv', 'iv', 'ext')}, {_KEPT}
SELECT row_number() OVER (ORDER BY image_ord, shoreline_id) - 1 AS Id, image_ord, shoreline_id, count(*) AS n, round(sum(x), 6) AS sum_x FROM kp GROUP BY image_ord, shoreline_id""")
def q_baseline_dedupe(t: Tables) -> DataFrame:
    vertices = views.line_vertices(t)
    rows = shorelines.baseline(vertices, views.extents(vertices))
    return rows.select("Id", "image_ord", "shoreline_id", "n", r6(F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v["x"])).alias("sum_x"))


@query(f"""{sql_with('pv')}, ex AS (SELECT vec_id, min(x) + vec_id * 0.2e0 AS xmin, max(x) + vec_id * 0.2e0 AS xmax, min(y) AS ymin, max(y) AS ymax FROM pv GROUP BY 1)
SELECT a.vec_id AS a, b.vec_id AS b FROM ex a JOIN ex b ON a.vec_id < b.vec_id AND a.xmax >= b.xmin AND b.xmax >= a.xmin AND a.ymax >= b.ymin AND b.ymax >= a.ymin""")
def q_bbox_overlap(t: Tables) -> DataFrame:
    rows = views.lines(t).select("vec_id", F.explode("vertices").alias("p"))
    shift = F.col("vec_id") * F.lit(0.2)
    ex = rows.groupBy("vec_id").agg((F.min("p.x")).alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("ymin"), F.max("p.y").alias("ymax"))
    return shorelines.overlapping_pairs(ex.select("vec_id", (F.col("x0") + shift).alias("xmin"), (F.col("x1") + shift).alias("xmax"), "ymin", "ymax"), "vec_id")


@query(f"""{sql_with('pv', 'iv', 'ext')}, f AS (SELECT * FROM ext WHERE image_ord = 0)
SELECT iv.image_ord, shoreline_id, count(*) AS n, count(*) FILTER (WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax) AS n_inside FROM iv, f GROUP BY ALL""")
def q_point_in_extent(t: Tables) -> DataFrame:
    vertices = views.line_vertices(t)
    first = F.broadcast(views.extents(vertices).where("image_ord = 0").drop("image_ord"))  # one row
    rows = vertices.join(first, F.lit(True))
    inside = geometry.within(F.col("x"), F.col("y"), {c: F.col(c) for c in shorelines.EXTENT})
    return rows.groupBy("image_ord", "shoreline_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"))


@query(f"""{sql_with('pv')} SELECT label % 2 AS src, count(DISTINCT vec_id) AS n, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM pv GROUP BY 1""")
def q_union_shorelines(t: Tables) -> DataFrame:
    lines = views.lines(t)
    both = shorelines.union_lines([(lines.where("label % 2 = 0"), 26917), (lines.where("label % 2 = 1"), 26917)], 26917)
    total = lambda c: F.round(F.sum(F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v[c])), 4).alias(f"sum_{c}")
    return both.groupBy((F.col("label") % 2).alias("src")).agg(F.count(F.lit(1)).alias("n"), total("x"), total("y"))


@query("""SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier""")
def q_union_first_schema(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return waterlevels.union_first_schema([a, b])


# Profiles

_CROSS = """nx AS (SELECT *, lead(dist) OVER w AS d1, lead(elev) OVER w AS e1 FROM sm WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
cr AS (SELECT vec_id, pos, dist + (0.05e0 - elev) / (e1 - elev) * (d1 - dist) AS hit FROM nx WHERE e1 IS NOT NULL AND sign(elev - 0.05e0) <> sign(e1 - 0.05e0))"""


@query(f"{sql_with('sm')}, {_CROSS} SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS k, round(hit, 6) AS dist FROM cr")
def q_crossings(t: Tables) -> DataFrame:
    rows = views.profiles(t).select("vec_id", F.posexplode(profiles.crossings(F.col("samples"), 0.05)).alias("k", "dist"))
    return rows.select("vec_id", F.col("k").cast("bigint").alias("k"), r6("dist").alias("dist"))


@query(f"{sql_with('sm')}, {_CROSS} SELECT vec_id, round(arg_min(hit, abs(hit - 60.3e0)), 6) AS dist FROM cr GROUP BY 1")
def q_refine_nearest(t: Tables) -> DataFrame:
    rows = views.profiles(t).select("vec_id", profiles.refine(profiles.crossings(F.col("samples"), 0.05), F.lit(60.3)).alias("dist"))
    return rows.where("dist IS NOT NULL").select("vec_id", r6("dist").alias("dist"))


@query(f"""{sql_with('sm')}, nx AS (SELECT *, lead(dist) OVER w AS d1, lead(elev) OVER w AS e1 FROM sm WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
cr AS (SELECT vec_id, dist + (0.3e0 - elev) / (e1 - elev) * (d1 - dist) AS hit FROM nx WHERE e1 IS NOT NULL AND sign(elev - 0.3e0) <> sign(e1 - 0.3e0)),
g AS (SELECT vec_id, count(*) AS n, arg_min(hit, abs(hit - 60.3e0)) AS r FROM cr GROUP BY 1)
SELECT vec_id, coalesce(n, 1) AS n, round(coalesce(r, -999), 6) AS refined FROM embeddings LEFT JOIN g USING (vec_id)""")
def q_sentinels(t: Tables) -> DataFrame:
    found = profiles.crossings(F.col("samples"), 0.3)
    rows = views.profiles(t).select("vec_id", found.alias("f"))
    return rows.select("vec_id", F.size(profiles.compatible_crossings(F.col("f"))).cast("bigint").alias("n"), r6(profiles.compatible_refined(profiles.refine(F.col("f"), F.lit(60.3)))).alias("refined"))


@query(f"""{sql_with('sm')}, k AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE (vec_id % 130) + 0.7e0 END AS want FROM embeddings),
c AS (SELECT vec_id, arg_min(pos, (abs(dist - want), pos)) AS m FROM sm JOIN k USING (vec_id) GROUP BY 1),
n AS (SELECT vec_id, dist AS d, elev AS e FROM sm JOIN c USING (vec_id) WHERE pos BETWEEN m - 1 AND m + 1)
SELECT vec_id, round(covar_pop(e, d) / var_pop(d), 6) AS slope FROM n GROUP BY 1""")
def q_beach_slope(t: Tables) -> DataFrame:
    want = F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(F.col("vec_id") % 130 + 0.7)
    return views.profiles(t).select("vec_id", r6(profiles.beach_slope(F.col("samples"), want)).alias("slope"))


@query(f"""{sql_with('pv')} SELECT a.vec_id, round(((degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 360), 6) AS azimuth
FROM pv a JOIN pv b ON a.vec_id = b.vec_id AND a.pos = 31 AND b.pos = 0""")
def q_azimuth(t: Tables) -> DataFrame:
    v = F.col("vertices")
    a, b = F.element_at(v, -1), F.get(v, F.lit(0))
    return views.lines(t).select("vec_id", r6(geometry.azimuth(a["x"], a["y"], b["x"], b["y"])).alias("azimuth"))


@query("""SELECT o_orderkey, date_diff('day', DATE '1998-02-28', o_orderdate::DATE) AS days FROM orders""")
def q_days_difference(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", names.days_difference(F.lit("19980228"), F.date_format("o_orderdate", "yyyyMMdd")).cast("bigint").alias("days"))


@query("""WITH p AS (SELECT TransectId, x0, y0, k, x0 + (x1 - x0) * k / 19 AS x, y0 + (y1 - y0) * k / 19 AS y FROM (
  SELECT c_custkey AS TransectId, 90e0 + c_custkey % 120 AS x0, 510e0 - c_custkey % 97 AS y0, 90e0 + c_custkey % 120 + c_custkey % 13 * 2.3e0 AS x1, 510e0 - c_custkey % 97 - c_custkey % 7 * 3.1e0 AS y1 FROM customer), range(20) AS r(k)),
c AS (SELECT *, floor((x - 100) / 2)::BIGINT AS col, floor((y - 500) / -2)::BIGINT AS row FROM p)
SELECT TransectId, k AS pos, round(p_retailprice, 6) AS elev FROM c LEFT JOIN part ON p_partkey = row * 50 + col AND col BETWEEN 0 AND 49 AND row >= 0""")
def q_dem_sample(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    lines = t.customer.select(
        k.alias("TransectId"), (F.lit(90.0) + k % 120).alias("x0"), (F.lit(510.0) - k % 97).alias("y0"),
        (F.lit(90.0) + k % 120 + k % 13 * F.lit(2.3)).alias("x1"), (F.lit(510.0) - k % 97 - k % 7 * F.lit(3.1)).alias("y1"),
    )
    found = profiles.sample_raster(lines, ["TransectId"], views.dem_tiles(t), views.affine(), 10, 20)
    rows = found.select("TransectId", F.posexplode("samples").alias("pos", "s"))
    return rows.select("TransectId", F.col("pos").cast("bigint").alias("pos"), number(F.col("s.elev")).alias("elev"))


# Water levels and calendars


@query("""WITH g AS (SELECT 2 * year(o_orderdate) - 1990 AS year, avg(o_totalprice / 997e0) AS level FROM orders GROUP BY 1),
b AS (SELECT min(year) AS a, max(year) AS z FROM g)
SELECT y AS year, round(level, 6) AS level FROM (SELECT unnest(range(a, z + 1)) AS y FROM b) LEFT JOIN g ON year = y""")
def q_yearly_level_gapfill(t: Tables) -> DataFrame:
    moved = F.make_date(2 * F.year("o_orderdate") - 1990, F.month("o_orderdate"), F.lit(1))  # every other year is a gap
    found = waterlevels.yearly_means(t.orders, moved, F.col("o_totalprice") / 997.0)
    return found.select(F.col("year").cast("bigint").alias("year"), r6("level").alias("level"))


@query("""WITH f AS (SELECT l_shipdate::DATE AS d, arg_min(l_extendedprice / 997e0, (l_orderkey, l_linenumber, l_extendedprice)) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(v, 6) AS verified_m FROM orders LEFT JOIN f ON d = o_orderdate::DATE - 400""")
def q_first_reading(t: Tables) -> DataFrame:
    readings = t.lineitem.select(F.col("l_shipdate").alias("Date"), (F.col("l_extendedprice") / 997.0).alias("verified_m"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("file_pos"))
    dates = t.orders.select("o_orderkey", F.date_sub("o_orderdate", 400).alias("Date"))  # the earliest have no reading
    return waterlevels.first_readings(readings, dates).select("o_orderkey", r6("verified_m").alias("verified_m"))


@query(f"""{sql_with('fn')} SELECT split_part(name, '_', 2) AS site, strftime(o_orderdate, '%Y') AS year, arg_max(strftime(o_orderdate, '%Y%m%d'), o_orderkey) AS dateinfo FROM fn GROUP BY 1, 2""")
def q_site_date_map(t: Tables) -> DataFrame:
    name = F.col("name")
    info = F.element_at(F.split(F.split_part(name, F.lit("."), F.lit(1)), "_"), -1)
    calendar = waterlevels.site_dates(views.file_names(t), names.archive_site(name), names.archive_year(name), info, F.col("o_orderkey"))
    rows = waterlevels.site_date_maps(calendar).select("site", F.explode("dates").alias("year", "dateinfo"))
    return rows


@query(f"""{sql_with('fn')}, cal AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_orderkey) AS k FROM fn GROUP BY ALL)
SELECT f.o_orderkey, strftime(m.o_orderdate, '%Y%m%d') AS dateinfo FROM orders f LEFT JOIN cal ON cal.o_custkey = f.o_custkey AND y = year(f.o_orderdate) - 1 LEFT JOIN orders m ON m.o_orderkey = k""")
def q_site_date_lookup(t: Tables) -> DataFrame:
    name = F.col("name")
    info = F.element_at(F.split(F.split_part(name, F.lit("."), F.lit(1)), "_"), -1)
    calendar = waterlevels.site_dates(views.file_names(t), names.archive_site(name), names.archive_year(name), info, F.col("o_orderkey"))
    rows = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("site"), (F.year("o_orderdate") - 1).cast("string").alias("year"))
    return waterlevels.lookup(rows, calendar).select("o_orderkey", "dateinfo")


# Names


@query(f"""{sql_with('fn')} SELECT o_orderkey, o_custkey::VARCHAR AS site, strftime(o_orderdate, '%Y') AS year, 'zip' AS suffix FROM fn""")
def q_parse_archive_name(t: Tables) -> DataFrame:
    name = F.col("name")
    return views.file_names(t).select("o_orderkey", names.archive_site(name).alias("site"), names.archive_year(name).alias("year"), names.suffix(name).alias("suffix"))


@query("""SELECT o_orderkey, year(o_orderdate) AS year, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS image_id, strftime(make_date(year(o_orderdate), 1, 1), '%Y/%m/%d') AS date FROM orders""")
def q_parse_year_id(t: Tables) -> DataFrame:
    head = F.when(F.col("o_orderkey") % 3 == 0, F.lit("lake")).otherwise(F.col("o_custkey").cast("string"))
    path = F.concat(F.lit("/images/x.y/"), head, F.lit("_"), F.year("o_orderdate").cast("string"), F.lit(".tif"))
    rows = t.orders.select("o_orderkey", names.stem(path).alias("stem"))
    year = names.year_of(F.col("stem"))
    return rows.select("o_orderkey", year.cast("bigint").alias("year"), names.id_of(F.col("stem")).cast("bigint").alias("image_id"), F.date_format(names.date_of(year), names.date_pattern("%Y/%m/%d")).alias("date"))


@query("""WITH m AS (SELECT c_custkey, ['m_' || c_custkey || '_sw_1998.pkl', 'm_' || c_custkey || '_ne_19990102.pkl', 'a_' || c_nationkey || '_nw_2001.pkl'] AS files FROM customer)
SELECT c_custkey, len(list_filter(files, lambda f: contains(f, 'm_'))) AS n_label,
  coalesce(list_filter(files, lambda f: contains(f, 'nw'))[1], '') AS nw, coalesce(list_filter(files, lambda f: contains(f, 'se'))[1], '') AS se,
  '1998' AS ymd, contains(files[1], '1998') AND contains(files[1], '7') AS hit FROM m""")
def q_meta_lookup(t: Tables) -> DataFrame:
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    files = F.array(F.concat(F.lit("m_"), key, F.lit("_sw_1998.pkl")), F.concat(F.lit("m_"), key, F.lit("_ne_19990102.pkl")), F.concat(F.lit("a_"), nation, F.lit("_nw_2001.pkl")))
    rows, f = t.customer.select("c_custkey", files.alias("files")), F.col("files")
    return rows.select(
        "c_custkey", F.size(shorelines.label_files(f, F.lit("m_"))).cast("bigint").alias("n_label"), shorelines.by_direction(f, F.lit("nw")).alias("nw"),
        shorelines.by_direction(f, F.lit("se")).alias("se"), shorelines.date_for_year(f).alias("ymd"), shorelines.meta_by_id_year(F.get(f, F.lit(0)), F.lit(7.0), F.lit(1998.0)).alias("hit"),
    )


@query("""WITH f AS (SELECT o_custkey, 'x_' || (CASE WHEN o_orderkey % 3 = 0 THEN 'h' ELSE '1' END) || '_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey AS name FROM orders),
g AS (SELECT *, bool_or(contains(name, '_1_')) OVER w AND bool_or(contains(name, '_h_')) OVER w AS both_kinds FROM f WINDOW w AS (PARTITION BY o_custkey)),
k AS (SELECT * FROM g WHERE NOT both_kinds OR contains(name, '_h_')),
d AS (SELECT o_custkey, regexp_extract(min(name), '_(\\d{8})', 1) AS first_day FROM k GROUP BY 1)
SELECT o_custkey, name FROM k JOIN d USING (o_custkey) WHERE regexp_extract(name, '_(\\d{8})', 1) = first_day""")
def q_candidate_files(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, "h").otherwise("1")
    name = F.concat(F.lit("x_"), kind, F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"))
    return shorelines.chosen_candidates(t.orders.select("o_custkey", name.alias("name")), ["o_custkey"])


# Maps and rasters

_A, _FL = crs.AXIS, crs.FLATTENING
_XI, _ETA = f"(y / {crs.SCALE * crs.RADIUS!r})", f"((x - 500000e0) / {crs.SCALE * crs.RADIUS!r})"
_U = _XI + "".join(f" - ({b!r}) * sin({2 * j} * {_XI}) * cosh({2 * j} * {_ETA})" for j, b in enumerate(crs.BETA, 1))
_V = _ETA + "".join(f" - ({b!r}) * cos({2 * j} * {_XI}) * sinh({2 * j} * {_ETA})" for j, b in enumerate(crs.BETA, 1))


@query(f"""WITH RECURSIVE g AS (SELECT c_custkey, 300000e0 + c_custkey % 4000 * 97 AS x, 3000000e0 + c_custkey * 311 % 2500000 AS y FROM customer),
uv AS (SELECT *, {_U} AS u, {_V} AS v FROM g), c AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM uv),
it AS (SELECT c_custkey, u, v, chi, chi AS phi, 0 AS k FROM c UNION ALL
  SELECT c_custkey, u, v, chi, 2 * atan(tan(pi() / 4 + chi / 2) * ((1 + {crs.ECCENTRICITY!r} * sin(phi)) / (1 - {crs.ECCENTRICITY!r} * sin(phi))) ** {crs.ECCENTRICITY / 2!r}) - pi() / 2, k + 1 FROM it WHERE k < 12)
SELECT c_custkey, round(degrees(atan2(sinh(v), cos(u))) + {crs.meridian(17)!r}, 6) AS lon, round(degrees(phi), 6) AS lat FROM it WHERE k = 12""")
def q_center_lonlat(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    # a raster of 2 by 2 m cells whose middle cell begins at the wanted point
    rows, cols = F.lit(101), F.lit(77)
    origin = F.struct(
        F.lit(2.0).alias("a"), F.lit(0.0).alias("b"), (F.lit(300000.0) + k % 4000 * 97 - 2.0 * F.floor(cols / 2)).alias("c"),
        F.lit(0.0).alias("d"), F.lit(-2.0).alias("e"), (F.lit(3000000.0) + k * 311 % 2500000 + 2.0 * F.floor(rows / 2)).alias("f"),
    )
    x, y = geometry.to_geo(F.floor(cols / 2), F.floor(rows / 2), origin)
    lon, lat = crs.reproject(x, y, 26917, 4326)
    return t.customer.select("c_custkey", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("""SELECT event_id, round(2.5e0 * value + 0.25e0 * (event_id % 301) + 1000, 6) AS x, round(0.5e0 * value - 2.5e0 * (event_id % 301) + 5000, 6) AS y FROM events""")
def q_affine(t: Tables) -> DataFrame:
    x, y = geometry.to_geo(F.col("value"), F.col("event_id") % 301, views.affine(2.5, 0.25, 1000, 0.5, -2.5, 5000))
    return t.events.select("event_id", r6(x).alias("x"), r6(y).alias("y"))


@query("""SELECT p_partkey, round(2.5e0 * (p_size * 10) + 0.25e0 * (p_partkey % 700) + 1000, 6) AS c, round(0.5e0 * (p_size * 10) - 2.5e0 * (p_partkey % 700) + 5000, 6) AS f FROM part""")
def q_split_meta(t: Tables) -> DataFrame:
    moved = geometry.window_transform(views.affine(2.5, 0.25, 1000, 0.5, -2.5, 5000), F.col("p_partkey") % 700, F.col("p_size") * 10)
    return t.part.select("p_partkey", r6(moved["c"]).alias("c"), r6(moved["f"]).alias("f"))


_GRID = "g AS (SELECT p_partkey, p_partkey % 4100 AS h, p_size * 90 AS w FROM part), t AS (SELECT p_partkey, h, w, i, j, h // 1000 AS nr, w // 1000 AS nc FROM g, range(5) AS a(i), range(5) AS b(j) WHERE i < h // 1000 AND j < w // 1000)"


def tiles(t: Tables, keep_rest: bool) -> DataFrame:
    rows = t.part.select("p_partkey", F.explode(rasters.tile_grid(F.col("p_partkey") % 4100, F.col("p_size") * 90, 1000, keep_rest)).alias("t"))
    return rows.select("p_partkey", *(F.col(f"t.{c}").cast("bigint").alias(c) for c in ("tile_row", "tile_col", "row0", "col0", "n_rows", "n_cols")))


@query(f"""WITH {_GRID} SELECT p_partkey, i AS tile_row, j AS tile_col, i * 1000 AS row0, j * 1000 AS col0,
  CASE WHEN i = nr - 1 THEN h - i * 1000 ELSE 1000 END AS n_rows, CASE WHEN j = nc - 1 THEN w - j * 1000 ELSE 1000 END AS n_cols FROM t""")
def q_tile_grid_keep(t: Tables) -> DataFrame:
    return tiles(t, True)


@query(f"WITH {_GRID} SELECT p_partkey, i AS tile_row, j AS tile_col, i * 1000 AS row0, j * 1000 AS col0, 1000::BIGINT AS n_rows, 1000::BIGINT AS n_cols FROM t")
def q_tile_grid_drop_remainder(t: Tables) -> DataFrame:
    return tiles(t, False)


@query("""SELECT p_brand, max(p_partkey % 17) AS max_row, max(p_size) AS max_col FROM part GROUP BY 1""")
def q_max_dims(t: Tables) -> DataFrame:
    name = F.concat((F.col("p_partkey") % 17).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.lit("_x.png"))
    rows = t.part.select("p_brand", names.tile_row(name).alias("tile_row"), names.tile_col(name).alias("tile_col"))
    return rasters.max_dims(rows, ["p_brand"]).select("p_brand", F.col("max_row").cast("bigint").alias("max_row"), "max_col")


def tile_pixels(t: Tables) -> DataFrame:
    """Fifty-column rasters of ten by ten tiles, one for each thousand parts, exploded."""
    row, col = F.floor(F.col("p_partkey") % 1000 / 50), F.col("p_partkey") % 50
    return t.part.select(
        F.floor(F.col("p_partkey") / 1000).alias("image"), F.floor(row / 10).alias("tile_row"), F.floor(col / 10).alias("tile_col"), (row % 10).alias("r"), (col % 10).alias("c"), F.col("p_size").alias("value")
    )


@query("SELECT p_partkey // 1000 AS image, p_partkey % 1000 // 50 AS row, p_partkey % 50 AS col, p_size AS value FROM part")
def q_stitch(t: Tables) -> DataFrame:
    cells = tile_pixels(t)
    by = cells.groupBy("image", "tile_row", "tile_col").agg(F.array_sort(F.collect_list(F.struct("r", "c", "value"))).alias("a"), (F.max("r") + 1).cast("int").alias("n_rows"), (F.max("c") + 1).cast("int").alias("n_cols"))
    whole = rasters.assemble(by.select("image", "tile_row", "tile_col", "n_rows", "n_cols", F.transform("a", lambda x: x["value"]).alias("cells")), ["image"])
    rows = whole.select("image", "n_cols", F.posexplode("cells").alias("k", "value"))
    return rows.select("image", F.floor(F.col("k") / F.col("n_cols")).alias("row"), (F.col("k") % F.col("n_cols")).cast("bigint").alias("col"), "value")


@query("""WITH s AS (SELECT l_partkey % 997 AS row, l_suppkey AS col, l_orderkey AS src, l_linenumber, CASE WHEN l_quantity > 10 THEN l_quantity END AS v FROM lineitem)
SELECT row, col, arg_min(v, (src, l_linenumber, v)) AS value FROM s WHERE v IS NOT NULL GROUP BY 1, 2""")
def q_mosaic_first(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_partkey") % 997).alias("row"), F.col("l_suppkey").alias("col"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("src"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("value"))
    return rasters.mosaic(rows, ["row", "col"], "src")


_RGB = "g AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 5 END AS r, p_partkey % 3 AS g, p_partkey % 4 AS b FROM part)"


@query(f"WITH {_RGB} SELECT p_partkey, floor(0.299e0 * r + 0.587e0 * g + 0.114e0 * b + 0.5e0)::BIGINT AS grey, floor(0.299e0 * r + 0.587e0 * g + 0.114e0 * b + 0.5e0) > 1 AS water FROM g")
def q_threshold(t: Tables) -> DataFrame:
    r, g, b = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_size") % 5), F.col("p_partkey") % 3, F.col("p_partkey") % 4
    return t.part.select("p_partkey", rasters.grey(r, g, b).alias("grey"), rasters.foreground(r, g, b).alias("water"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 128 ELSE 0 END AS r, 0 AS g, 0 AS b FROM part")
def q_palette(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", rasters.palette(F.col("p_size") % 2).alias("c")).select("p_partkey", "c.*")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY path DESC) - 1) // 20 AS batch FROM (SELECT o_orderkey, 'f_' || o_orderkey || '.shp' AS path FROM orders)")
def q_batch20(t: Tables) -> DataFrame:
    files = t.orders.select("o_orderkey", F.concat(F.lit("f_"), F.col("o_orderkey").cast("string"), F.lit(".shp")).alias("path"))
    return waterlevels.batches(files).select("o_orderkey", "batch")


# Transects

_CAST = """sg AS (SELECT Id, pos, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM bl WINDOW w AS (PARTITION BY Id ORDER BY pos)),
sl AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS w FROM sg WHERE x2 IS NOT NULL),
cu AS (SELECT *, sum(w) OVER (PARTITION BY Id ORDER BY pos) AS s FROM sl),
le AS (SELECT Id, max(s) AS l FROM cu GROUP BY 1),
st AS (SELECT Id, k, k * 15e0 AS d FROM le, range(200) AS r(k) WHERE k <= floor(l / 15)),
ap AS (SELECT st.Id, k, d, (SELECT min(pos) FROM cu WHERE cu.Id = st.Id AND s >= d) AS pos FROM st),
tc AS (SELECT Id AS BaselineId, k AS TransectId, x + (d - (s - w)) * (x2 - x) / w AS bx, y + (d - (s - w)) * (y2 - y) / w AS bz, -(y2 - y) / w AS nx, (x2 - x) / w AS ny FROM ap JOIN cu USING (Id, pos)),
ts AS (SELECT BaselineId, TransectId, bx, bz, bx - 60 * nx AS x0, bz - 60 * ny AS y0, bx + 60 * nx AS x1, bz + 60 * ny AS y1 FROM tc)"""


def cast_transects(t: Tables) -> DataFrame:
    return transects.cast(views.coast(t)[0], length=120.0, spacing=15.0)


@query(f"{sql_with('bl')}, {_CAST} SELECT BaselineId, TransectId, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM ts")
def q_cast_transects(t: Tables) -> DataFrame:
    return cast_transects(t).select(*KEYS, *(r6(c).alias(c) for c in transects.ENDS))


_MET = f"""{_CAST}, ss AS (SELECT ImageId, Date, x AS sx0, y AS sy0, lead(x) OVER w AS sx1, lead(y) OVER w AS sy1 FROM sh WINDOW w AS (PARTITION BY ImageId ORDER BY pos)),
pa AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, sx1 - sx0 AS ex, sy1 - sy0 AS ey, sx0 - x0 AS px, sy0 - y0 AS py FROM ts JOIN ss ON sx1 IS NOT NULL AND BaselineId // 10 = ImageId // 10),
pc AS (SELECT *, dx * ey - dy * ex AS cr FROM pa), pu AS (SELECT *, (px * ey - py * ex) / cr AS u, (px * dy - py * dx) / cr AS v FROM pc WHERE cr <> 0),
me AS (SELECT BaselineId, TransectId, ImageId, Date, ((x0 + u * dx - bx) * dx + (y0 + u * dy - bz) * dy) / sqrt(dx * dx + dy * dy) AS ref_dist FROM pu WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1)"""


def intersected(t: Tables, mode: str) -> DataFrame:
    return transects.intersect(cast_transects(t), views.coast(t)[1], CELL, mode)


@query(f"""{sql_with('bl', 'sh')}, {_MET} SELECT BaselineId, TransectId, ImageId, strftime(Date, '%Y/%m/%d') AS Date, round(arg_min(ref_dist, (abs(ref_dist), ref_dist)), 6) AS ref_dist FROM me GROUP BY ALL""")
def q_intersect_closest(t: Tables) -> DataFrame:
    return intersected(t, "closest").select(*KEYS, "ImageId", F.date_format("Date", "yyyy/MM/dd").alias("Date"), r6("ref_dist").alias("ref_dist"))


@query(f"""{sql_with('bl', 'sh')}, {_MET} SELECT BaselineId, TransectId, ImageId, strftime(Date, '%Y/%m/%d') AS Date, round(arg_min(ref_dist, (-abs(ref_dist), ref_dist)), 6) AS ref_dist FROM me GROUP BY ALL""")
def q_intersect_farthest(t: Tables) -> DataFrame:
    return intersected(t, "farthest").select(*KEYS, "ImageId", F.date_format("Date", "yyyy/MM/dd").alias("Date"), r6("ref_dist").alias("ref_dist"))


@query(f"""{sql_with('bl', 'sh')}, {_MET}, cl AS (SELECT BaselineId, TransectId, ImageId, year(Date) - 1990 AS t, arg_min(ref_dist, (abs(ref_dist), ref_dist)) AS d FROM me GROUP BY ALL),
a AS (SELECT BaselineId, TransectId, {_STATS} FROM cl GROUP BY ALL) SELECT BaselineId, TransectId, n, round({_SLOPE}, 6) AS ChangeRate FROM a""")
def q_transect_rate(t: Tables) -> DataFrame:
    return transects.transect_rates(intersected(t, "closest")).select(*KEYS, "n", r6("ChangeRate").alias("ChangeRate"))


# Kernels without SQL


@query()
def q_border_following(t: Tables) -> DataFrame:
    """Contours of one mask per thousand parts: rows of fifty pixels, set where the size is over 20."""
    cells = tile_pixels(t).select("image", F.struct((F.col("tile_row") * 10 + F.col("r")).alias("row"), (F.col("tile_col") * 10 + F.col("c")).alias("col"), F.when(F.col("value") > 20, "01").otherwise("00").alias("v")).alias("p"))
    masks = cells.groupBy("image").agg(F.array_sort(F.collect_list("p")).alias("p")).select("image", F.floor(F.size("p") / 50).cast("int").alias("n_rows"), F.lit(50).alias("n_cols"), F.unhex(F.array_join(F.col("p")["v"], "")).alias("mask"))
    return rasters.contours(masks, ["image"], margin=1)


@query()
def q_segment_preprocess(t: Tables) -> DataFrame:
    """Masks of small pictures by a stand-in model that scores the red channel: image and number of water pixels."""
    from tidemark.operators.segmentation import segment

    cells = tile_pixels(t).select("image", F.struct((F.col("tile_row") * 10 + F.col("r")).alias("row"), (F.col("tile_col") * 10 + F.col("c")).alias("col"), F.lpad(F.hex("value"), 2, "0").alias("v")).alias("p"))
    pictures = cells.groupBy("image").agg(F.array_sort(F.collect_list("p")).alias("p"))
    bgr = F.unhex(F.array_join(F.transform(F.col("p")["v"], lambda v: F.concat(F.lit("0000"), v)), ""))
    masks = segment(pictures.select("image", F.floor(F.size("p") / 50).cast("int").alias("n_rows"), F.lit(50).alias("n_cols"), bgr.alias("bgr")), _stand_in)
    ones = F.size(F.filter(F.split(F.hex("mask"), "(?<=\\G..)"), lambda x: x == "01"))
    return masks.select("image", ones.cast("bigint").alias("water_pixels"))


def _stand_in():
    import numpy as np

    return lambda x: np.concatenate([np.full_like(x[:, :1], -1.6), x[:, :1]], 1)[:, :, ::8, ::8]
