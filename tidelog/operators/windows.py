"""Time windows over stored events (beyond the order that logs have by themselves)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(log: DataFrame, width: str, *by: str) -> DataFrame:
    return sliding(log, width, None, *by)


def sliding(log: DataFrame, width: str, slide: str | None, *by: str) -> DataFrame:
    window = F.window("occurred_at", width, slide) if slide else F.window("occurred_at", width)
    return log.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("window_start"), *by, "events")


def sessions(log: DataFrame, gap: str, by: str = "stream_id") -> DataFrame:
    return log.groupBy(F.session_window("occurred_at", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "events")


def rollup(log: DataFrame, *by: str) -> DataFrame:
    return log.rollup(*by).agg(F.count(F.lit(1)).alias("events"))


def once_each(log: DataFrame) -> DataFrame:
    """Each event id once."""
    return log.dropDuplicates(["event_id"])
