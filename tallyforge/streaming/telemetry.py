"""Telemetry summaries over event-time windows, for batch and streaming tables alike.

An extension: windows are closed by a watermark, and a request later than that is left out. Percentiles in
a stream are approximate, as state must stay bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, latency: str, failed: str, by: Sequence[str] = (), width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", accuracy: int = 10_000) -> DataFrame:
    """Counts and latency of each window; ``failed`` is a SQL condition."""
    bad = F.coalesce(F.expr(failed), F.lit(False))
    kept = F.when(~bad, F.col(latency))
    window = F.window(time, width, slide) if slide else F.window(time, width)
    at = F.percentile_approx(kept, [0.5, 0.95, 0.99], accuracy)
    out = df.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(
        F.count("*").alias("total_requests"), F.count_if(bad).alias("failed_requests"), F.min(kept).alias("latency_min"), F.max(kept).alias("latency_max"), F.avg(kept).alias("latency_mean"), at.alias("_p")
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "total_requests", "failed_requests", "latency_min", "latency_max", "latency_mean", *[F.col("_p")[k].alias(f"latency_p{p}") for k, p in enumerate((50, 95, 99))])


def sessions(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: runs of events no further apart than the gap."""
    return (
        df.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("s"), key)
        .agg(F.count("*").alias("n_events"))
        .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")
    )
