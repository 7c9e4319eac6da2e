"""Current rows of files from a stream of indexings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(stream: DataFrame, key: str, at: str, cols: list[str]) -> DataFrame:
    """The latest row per key so far (update or complete mode); late older readings change nothing."""
    return stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *cols)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in (at, *cols)])


def arrivals(stream: DataFrame, at: str, by: str, every: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per window of event time and group; windows close once nothing later than ``late`` can come."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), by).agg(F.count(F.lit(1)).alias("n"))
