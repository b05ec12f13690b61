"""The star-schema tables in the roles of shoreline data, for Spark and, as SQL, for the oracle.

customer: transects; orders: intersections; lineitem: water levels; embeddings: polylines and profiles; events: contour
vertices; part: DEM cells; order keys and dates: file names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geometry import near_edge, polyline
from tidemark.operators.transects import numbered


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def transects(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("BaselineId"), F.col("c_custkey").alias("TransectId"), (0.01 + (F.col("c_custkey") % 50) / 997.0).alias("slope"))


def intersections(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_nationkey").alias("BaselineId"), F.col("o_custkey").alias("TransectId"), "o_orderkey", F.col("o_orderdate").alias("Date"), (F.col("o_totalprice") / 997.0).alias("ref_dist"))


def levels(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.avg("l_quantity").alias("level"))


def lines(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", (2000 + F.col("vec_id")).alias("year"), polyline(F.col("embedding")).alias("vertices"))


def line_vertices(t: Tables) -> DataFrame:
    """Vertices of the polylines, each label's images shifted: image_ord, shoreline_id, pos, x, y."""
    rows = lines(t).select("label", "vec_id", F.posexplode("vertices").alias("pos", "p"))
    return rows.select(F.col("label").alias("image_ord"), F.col("vec_id").alias("shoreline_id"), "pos", (F.col("p.x") + F.col("label") * F.lit(0.1)).alias("x"), F.col("p.y").alias("y"))


def extents(vertices: DataFrame, key: str = "image_ord") -> DataFrame:
    return vertices.groupBy(key).agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def profiles(t: Tables) -> DataFrame:
    """64 samples at distances 0 to 126."""
    samples = F.transform("embedding", lambda e, i: F.struct((i * F.lit(2.0)).alias("dist"), e.cast("double").alias("elev")))
    return t.embeddings.select("vec_id", samples.alias("samples"))


def contour_vertices(t: Tables, margin: int = 20) -> DataFrame:
    """image_ord, contour_id, pos, x, y, edge: events of a user in order of time, on images of 400 columns and 401 rows."""
    rows = t.events.select((F.col("user_id") % 5).alias("image_ord"), F.col("user_id").alias("contour_id"), "ts", "event_id", F.col("value").alias("x"), (F.col("event_id") % 359 + 20.5).alias("y"))
    rows = numbered(rows, ["image_ord", "contour_id"], ["ts", "event_id"], "pos").drop("ts", "event_id")
    return rows.withColumn("edge", near_edge(F.col("x"), F.col("y"), F.lit(400), F.lit(401), margin))


def coast(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(baselines, shorelines): every line is a baseline of its site of ten, sites far from one another, and a dated line there."""
    e = F.col("embedding")
    at = F.sequence(F.lit(0), F.lit(31))
    base = F.transform(at, lambda i: F.struct((i * 10.0 + F.floor(F.col("vec_id") / 10) * 1000.0).alias("x"), (F.get(e, 2 * i + 1).cast("double") * 20.0).alias("y")))
    shore = F.transform(at, lambda i: F.struct((i * 10.0 + F.floor(F.col("vec_id") / 10) * 1000.0).alias("x"), (F.get(e, 2 * i + 1).cast("double") * 20.0 + 15.0 + F.col("vec_id") / 97.0).alias("y")))
    baselines = t.embeddings.select(F.col("vec_id").alias("Id"), base.alias("vertices"))
    day = F.make_date((1990 + F.col("vec_id") % 10).cast("int"), F.lit(1), F.lit(1))
    return baselines, t.embeddings.select(F.col("vec_id").alias("ImageId"), day.alias("Date"), shore.alias("vertices"))


def file_names(t: Tables) -> DataFrame:
    """order key, name: archive names with site, direction and day."""
    direction = F.element_at(F.array(*(F.lit(x) for x in ("sw", "se", "nw", "ne"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("m_"), F.col("o_custkey").cast("string"), F.lit("_"), direction, F.lit("_16_1_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".zip"))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", name.alias("name"))


def dem_tiles(t: Tables, tile: int = 10) -> DataFrame:
    """Fifty columns of cells, row by row."""
    row, col = F.floor(F.col("p_partkey") / 50), F.col("p_partkey") % 50
    cells = t.part.select(F.floor(row / tile).alias("tile_row"), F.floor(col / tile).alias("tile_col"), (row % tile).alias("r"), (col % tile).alias("c"), F.col("p_retailprice").alias("v"))
    by = cells.groupBy("tile_row", "tile_col").agg(F.array_sort(F.collect_list(F.struct("r", "c", "v"))).alias("a"), (F.max("c") + 1).alias("n_cols"))
    return by.select("tile_row", "tile_col", "n_cols", F.transform("a", lambda x: x["v"]).alias("cells"))


def affine(a: float = 2.0, b: float = 0.0, c: float = 100.0, d: float = 0.0, e: float = -2.0, f: float = 500.0) -> Column:
    return F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)))


#: The same views in SQL, by name.
SQL = {
    "tr": "tr AS (SELECT c_nationkey AS BaselineId, c_custkey AS TransectId, 0.01e0 + (c_custkey % 50) / 997e0 AS slope FROM customer)",
    "ix": "ix AS (SELECT c_nationkey AS BaselineId, o_custkey AS TransectId, o_orderkey, o_orderdate AS Date, year(o_orderdate) AS y, o_totalprice / 997e0 AS ref_dist FROM orders JOIN customer ON o_custkey = c_custkey)",
    "wl": "wl AS (SELECT year(l_shipdate) AS year, avg(l_quantity) AS level FROM lineitem GROUP BY 1)",
    "pv": "pv AS (SELECT vec_id, label, i AS pos, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(32) AS r(i))",
    "iv": "iv AS (SELECT label AS image_ord, vec_id AS shoreline_id, pos, x + label * 0.1e0 AS x, y FROM pv)",
    "ext": "ext AS (SELECT image_ord, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM iv GROUP BY 1)",
    "pr": "pr AS (SELECT * FROM (SELECT label, vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL)",
    "sm": "sm AS (SELECT vec_id, i AS pos, i * 2e0 AS dist, embedding[i + 1]::DOUBLE AS elev FROM embeddings, range(64) AS r(i))",
    "cv": "cv AS (SELECT user_id % 5 AS image_ord, user_id AS contour_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x, event_id % 359 + 20.5e0 AS y FROM events)",
    "ce": "ce AS (SELECT *, x <= 20 OR y <= 20 OR x >= 380 OR y >= 381 AS edge FROM cv)",
    "fn": "fn AS (SELECT o_orderkey, o_custkey, o_orderdate, 'm_' || o_custkey || '_' || ['sw', 'se', 'nw', 'ne'][o_orderkey % 4 + 1] || '_16_1_' || strftime(o_orderdate, '%Y%m%d') || '.zip' AS name FROM orders)",
    "bl": "bl AS (SELECT vec_id AS Id, i AS pos, i * 10e0 + (vec_id // 10) * 1000e0 AS x, embedding[2 * i + 2]::DOUBLE * 20e0 AS y FROM embeddings, range(32) AS r(i))",
    "sh": "sh AS (SELECT vec_id AS ImageId, make_date(1990 + vec_id % 10, 1, 1) AS Date, i AS pos, i * 10e0 + (vec_id // 10) * 1000e0 AS x, embedding[2 * i + 2]::DOUBLE * 20e0 + 15e0 + vec_id / 97e0 AS y FROM embeddings, range(32) AS r(i))",
}


def sql_with(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
