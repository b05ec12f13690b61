"""Change rates, water-level calibration, outliers, and rates of shoreline similarity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import NAN, ieee_divide, orientation_free_frechet

#: A lookup of at most so many rows is broadcast; calendars of water levels are far below.
LOOKUP_ROWS = 100_000


def rate_stats(t: Column, d: Column, order: Column) -> list[Column]:
    """Mergeable aggregates that ``rate`` needs; ``order`` says which of two observations came first."""
    t, d = t.cast("double"), d.cast("double")
    return [
        F.count(F.lit(1)).alias("n"),
        F.var_pop(t).alias("var_t"),
        F.covar_pop(d, t).alias("cov"),
        F.min_by(d, order).alias("d_first"),
        F.max_by(d, order).alias("d_last"),
        F.coalesce(F.bool_or(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))), F.lit(False)).alias("odd"),
    ]


def rate(n: Column, var_t: Column, cov: Column, d_first: Column, d_last: Column, odd: Column) -> Column:
    """Slope of d on t.

    Fewer than two observations: null. Two: the difference quotient, which at equal times is not a number or infinite.
    More: least squares, 0 at equal times, null where an observation is not finite.
    """
    two = F.when(var_t > 0, cov / F.when(var_t > 0, var_t)).otherwise(ieee_divide(d_last - d_first, F.lit(0.0)))
    return F.when(n < 2, F.lit(None).cast("double")).when(n == 2, two).when(odd, F.lit(None).cast("double")).when(var_t > 0, cov / F.when(var_t > 0, var_t)).otherwise(0.0)


def change_rates(observations: DataFrame, keys: Sequence[str], t: Column, d: Column, order: Column | None = None, name: str = "ChangeRate") -> DataFrame:
    """One row per key: the rate, and n, the number of observations. One aggregation, combined before the shuffle."""
    order = F.struct(t, d) if order is None else order
    stats = observations.groupBy(*keys).agg(*rate_stats(t, d, order))
    return stats.select(*keys, "n", rate(*(F.col(c) for c in ("n", "var_t", "cov", "d_first", "d_last", "odd"))).alias(name))


def levels_from(spark, levels: Mapping[int, float]) -> DataFrame:
    """(year, level) rows of a plain mapping."""
    return spark.createDataFrame([(int(k), float(v)) for k, v in levels.items()], "year int, level double")


def reference_level(levels: DataFrame) -> Column:
    """Mean over the entries of the level table, each counted once; a scalar subquery."""
    return levels.agg(F.avg("level")).scalar()


def predicted_shift(level: Column, reference: Column, slope: Column) -> Column:
    """How far the waterline moves for a level above the reference on a beach of that slope."""
    return ieee_divide(-(level - reference), slope)


def with_levels(intersections: DataFrame, levels: DataFrame, year: Column, strict: bool = True) -> DataFrame:
    """Intersections with their year's water level. A year without one is an error, or a null if not ``strict``."""
    held = levels.select(F.col("year").alias("_y"), F.col("level").alias("_l"))
    small = F.broadcast(held) if levels.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else held
    joined = intersections.join(small, year == F.col("_y"), "left")
    level = F.coalesce("_l", F.raise_error(F.concat(F.lit("no water level for year "), year.cast("string"))).cast("double")) if strict else F.col("_l")
    return joined.withColumn("level", level).drop("_y", "_l")


def calibrate(
    transects: DataFrame, intersections: DataFrame, levels: DataFrame, slope_field: str = "slope", reference: float | None = None,
    date_field: str = "Date", keys: Sequence[str] = ("BaselineId", "TransectId"), strict: bool = True,
) -> DataFrame:
    """Change rates less the part that water levels explain: keys, ChangeRate, slope, calibrated_rate.

    The predicted shift is the level's departure from the reference over the slope, the same slope for all of a
    transect's dates, so its rate is the level's rate over the slope: one aggregation of the intersections by transect,
    then one join. Transect rows stay as they are, repeated ones too; one without intersections, or with one, keeps its
    rate. The two-observation case keeps both levels, as its quotient can be infinite or not a number.
    """
    year = F.year(F.col(date_field))
    rows = with_levels(intersections, levels, year, strict)
    stats = rows.groupBy(*keys).agg(*rate_stats(year, F.col("level"), F.struct(year, "level")), F.min(year).alias("t_first"), F.max(year).alias("t_last"))
    base = F.lit(float(reference)) if reference is not None else reference_level(levels)
    joined = transects.join(stats, list(keys), "left")
    slope, n = F.col(slope_field).cast("double"), F.col("n")
    shift_first, shift_last = (predicted_shift(F.col(c), base, slope) for c in ("d_first", "d_last"))
    two = ieee_divide(shift_last - shift_first, (F.col("t_last") - F.col("t_first")).cast("double"))
    usable = slope.isNotNull() & ~F.isnan(slope) & (slope != 0) & ~F.col("odd") & (F.col("var_t") > 0)
    many = F.when(usable, -(F.col("cov") / F.when(usable, F.col("var_t"))) / F.when(usable, slope)).otherwise(0.0)
    moved = F.when(n.isNull() | (n < 2), 0.0).when(n == 2, two).otherwise(many)
    return joined.select(*keys, "ChangeRate", slope_field, (F.col("ChangeRate") - moved).alias("calibrated_rate"))


def flag_outliers(rows: DataFrame, value: str, keys: Sequence[str] = (), rate: float = 3.0, two_sided: bool = False, name: str = "outlier") -> DataFrame:
    """Is a value more than ``rate`` sample deviations above its group's mean (or on either side)? Groups of one, or without spread, have none.

    Group figures are aggregated first and joined back, so a hot group is not gathered for a window.
    """
    v = F.col(value).cast("double")
    figures = [F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"), F.count(v).alias("_n"), (F.max(v) > F.min(v)).alias("_spread")]
    if keys:
        held = rows.groupBy(*keys).agg(*figures)
        both = rows.join(held.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_mean", "_sd", "_n", "_spread"), [rows[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    else:
        both = rows.join(F.broadcast(rows.agg(*figures)), F.lit(True), "left")
    away = F.abs(v - F.col("_mean")) if two_sided else v - F.col("_mean")
    flag = F.coalesce((F.col("_n") >= 2) & F.col("_spread") & (F.col("_sd") > 0) & (away > rate * F.col("_sd")), F.lit(False))
    return both.select(*(rows[c] for c in rows.columns), flag.alias(name))


def frechet_rates(lines: DataFrame, keys: Sequence[str], year: Column, order: Column, line: str = "vertices") -> DataFrame:
    """Keys, year_start, year_end, distance, rate of each pair of neighbours in (year, order).

    A pair of one year is skipped and not paired anew. The distance is free of orientation.
    """
    w = Window.partitionBy(*keys).orderBy("_t", "_o")
    rows = lines.select(*keys, year.cast("double").alias("_t"), order.alias("_o"), F.col(line).alias("_a"))
    pairs = rows.select(*keys, "_t", "_a", F.lead("_t").over(w).alias("_u"), F.lead("_a").over(w).alias("_b")).where("_u <> _t")
    found = pairs.select(*keys, F.col("_t").alias("year_start"), F.col("_u").alias("year_end"), orientation_free_frechet(F.col("_a"), F.col("_b")).alias("distance"))
    return found.withColumn("rate", F.col("distance") / (F.col("year_end") - F.col("year_start")))


__all__ = ["NAN", "calibrate", "change_rates", "flag_outliers", "frechet_rates", "levels_from", "predicted_shift", "rate", "rate_stats", "reference_level", "with_levels"]
