"""Link bins over a stream of traversals: event-time windows with a watermark for late vehicles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_link_bins(traversals: DataFrame, width: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Crossings, pcu and pcu-seconds by link and exit window. traversals has the exit as a timestamp `exit_at`, link, pcu, seconds."""
    w = F.window("exit_at", width)
    return traversals.withWatermark("exit_at", late).groupBy(w, "link").agg(F.count("*").alias("crossings"), F.sum("pcu").alias("pcu"), F.sum(F.col("pcu") * F.col("seconds")).alias("pcu_seconds")).select(F.col("window.start").alias("start"), "link", "crossings", "pcu", "pcu_seconds")


def rolling_peaks(traversals: DataFrame, window: str = "15 minutes", step: str = "1 minute", late: str = "30 minutes") -> DataFrame:
    """Sliding sums of pcu by link, for the busiest quarter of an hour."""
    return traversals.withWatermark("exit_at", late).groupBy(F.window("exit_at", window, step), "link").agg(F.sum("pcu").alias("pcu")).select(F.col("window.start").alias("start"), "link", "pcu")
