"""Water-level readings, yearly means, and site calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yearly_means(rows: DataFrame, date: Column, value: Column, name: str = "level") -> DataFrame:
    """(year, mean) of every calendar year from the first to the last; a null where a year has no value."""
    some = rows.where(date.isNotNull()).groupBy(F.year(date).alias("year")).agg(F.avg(value.cast("double")).alias(name))
    every = some.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    return every.join(some, "year", "left")


def first_readings(readings: DataFrame, dates: DataFrame, date: str = "Date", value: str = "verified_m", order: str = "file_pos") -> DataFrame:
    """Each asked date with the first reading of that day in file order; null if there is none. Reduced before the join."""
    firsts = readings.groupBy(F.to_date(date).alias("_d")).agg(F.min_by(value, order).alias(value))
    asked = dates.withColumn("_a", F.to_date(date))
    return asked.join(firsts, asked["_a"] == firsts["_d"], "left").drop("_a", "_d")


def site_dates(files: DataFrame, site: Column, year: Column, info: Column, order: Column) -> DataFrame:
    """(site, year, dateinfo): of files with one site and year the last one counts."""
    return files.groupBy(site.alias("site"), year.alias("year")).agg(F.max_by(info, order).alias("dateinfo"))


def site_date_maps(calendar: DataFrame) -> DataFrame:
    """(site, dates): a map from year to date info."""
    return calendar.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "dateinfo")))).alias("dates"))


def lookup(rows: DataFrame, calendar: DataFrame, keys: Sequence[str] = ("site", "year")) -> DataFrame:
    """The date info of each row's site and year, null if unknown."""
    return rows.join(calendar, list(keys), "left")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame | None:
    """All rows, columns matched by name, missing ones null; nothing gives None."""
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def union_first_schema(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows with the columns of the first frame; what another lacks is null, what it has besides goes."""
    first = frames[0]
    out = first
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*(F.col(c) if c in frame.columns else F.lit(None).cast(first.schema[c].dataType).alias(c) for c in first.columns)))
    return out


def batches(files: DataFrame, path: str = "path", size: int = 20, ranges: int = 64) -> DataFrame:
    """Files with a batch number: sorted, taken from the end, ``size`` at a time.

    A sample of the paths cuts them into ranges, which are numbered each; ranges have offsets. Null paths come last.
    """
    n = files.count()
    some = sorted({r[0] for r in files.where(F.col(path).isNotNull()).select(path).sample(min(1.0, 50 * ranges / max(n, 1)), 7).collect()})
    cuts = some[:: max(1, len(some) // ranges)]
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(path))) if cuts else F.lit(0)
    held = files.withColumn("_r", F.when(F.col(path).isNull(), -1).otherwise(at))
    ahead = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).select("_r", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_r").orderBy(F.desc(path))) - 1
    return held.join(F.broadcast(offsets), "_r").withColumn("batch", F.floor((F.col("_ahead") + own) / size).cast("bigint")).drop("_r", "_ahead")
