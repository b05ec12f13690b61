"""Change rates that follow a stream of intersections: a stateful aggregation of mergeable statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rates import change_rates


def streaming_rates(found: DataFrame, keys: Sequence[str] = ("BaselineId", "TransectId"), date: str = "Date", value: str = "ref_dist") -> DataFrame:
    """Rates per transect so far, for update or complete mode. State: six numbers a transect; no rows are kept."""
    return change_rates(found, list(keys), F.year(date), F.col(value), F.struct(date, value))


def windowed_means(readings: DataFrame, date: str = "ts", value: str = "value", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Mean level per time window, final once the watermark has passed."""
    return readings.withWatermark(date, late).groupBy(F.window(date, length)).agg(F.avg(value).alias("level"), F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "level", "n")
