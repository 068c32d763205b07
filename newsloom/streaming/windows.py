"""Watermarked forms: distinct observations, sessions, daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_prices(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One row for each (symbol, observed_at); a refetch of a closed market is no observation."""
    timed = stream.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", lateness)
    return timed.dropDuplicates(["symbol", "observed_at"])


def sessions(stream: DataFrame, gap: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """A run closes when it has been idle for ``gap``."""
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
    s = timed.groupBy("run_id", F.session_window("created_at", gap).alias("w")).agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("n"))
    return s.select("run_id", "started_at", "ended_at", "n")


def daily_counts(stream: DataFrame, time: str, key: str, lateness: str = "1 day") -> DataFrame:
    """Tumbling days."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), key, "n")
