"""Request telemetry: latency percentiles, failures, token totals and throughput by group, in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.95, 0.99)


def _stats(value: Column, keep: Column, prefix: str, accuracy: int | None = None) -> list[Column]:
    kept = F.when(keep & ~F.isnan(value), value)
    at = percentiles(kept, accuracy)
    return [
        F.count(kept).alias(f"{prefix}_count"),
        F.avg(kept).alias(f"{prefix}_mean"),
        F.min(kept).alias(f"{prefix}_min"),
        F.max(kept).alias(f"{prefix}_max"),
        *[F.try_element_at(at, F.lit(k + 1)).alias(f"{prefix}_p{round(p * 100)}") for k, p in enumerate(PERCENTILES)],
    ]


def percentiles(value: Column, accuracy: int | None = None) -> Column:
    """``PERCENTILES`` as an array: exact, with linear interpolation; or, given an accuracy, values whose rank is off by at most
    ``1 / accuracy`` of the rows. Exact ones keep every different value of a group in memory; a group of billions wants the other."""
    if accuracy is None:
        return F.percentile(value, F.array(*[F.lit(p) for p in PERCENTILES]))
    return F.percentile_approx(value, list(PERCENTILES), accuracy)


def summarize(df: DataFrame, by: Sequence[str], latency: str, ok: Column, accuracy: int | None = None) -> DataFrame:
    """Counts and percentiles (see ``percentiles``) of the successful requests of each group.

    Failed requests count in ``total`` and ``failed`` only. Null and NaN latencies count in neither the
    statistics nor their ``count``. A group without a successful request has null statistics.
    """
    succeeded = F.coalesce(ok, F.lit(False))
    return df.groupBy(*by).agg(
        F.count("*").alias("total_requests"),
        F.count_if(succeeded).alias("successful_requests"),
        F.count_if(~succeeded).alias("failed_requests"),
        *_stats(F.col(latency), succeeded, "latency", accuracy),
    )


def rate_sweep(df: DataFrame, by: Sequence[str], strict: bool = False, accuracy: int | None = None) -> DataFrame:
    """Summary of every load level: both latencies, tokens and throughput, as one aggregate.

    ``effective_throughput_tps`` is tokens of the successful requests over the slowest single request (of
    all rows), as such tools publish it; ``wall_throughput_tps`` is over the time from the first request
    sent to the last one answered. ``strict`` also asks for status 200. Denominators of 0 give 0.
    """
    ok = F.col("error").isNull()
    if strict:
        ok = ok & (F.coalesce(F.col("status"), F.lit(0)) == 200)
    latency = F.when(~F.isnan("latency_ms"), F.col("latency_ms"))
    tokens = F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0))
    sent = F.unix_micros(F.col("sent_at").cast("timestamp")) / 1e6
    wall = F.max(sent + F.coalesce(latency, F.lit(0.0)) / 1000) - F.min(sent)
    return df.groupBy(*by).agg(
        F.count("*").alias("total_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.count_if(~ok).alias("failed_requests"),
        tokens.alias("total_output_tokens"),
        F.coalesce(F.try_divide(tokens.cast("double"), F.max(latency) / 1000), F.lit(0.0)).alias("effective_throughput_tps"),
        F.coalesce(F.try_divide(tokens.cast("double"), wall), F.lit(0.0)).alias("wall_throughput_tps"),
        *_stats(F.col("latency_ms"), ok, "latency", accuracy),
        *_stats(F.col("ttfb_ms"), ok & F.col("ttfb_ms").isNotNull(), "ttfb", accuracy),
    )


def warm_up(df: DataFrame, is_warm_up: Column, ok: Column) -> tuple[DataFrame, DataFrame]:
    """One row with the number of warm-up requests and of those that succeeded; and the other requests."""
    warm = F.coalesce(is_warm_up, F.lit(False))
    return df.where(warm).agg(F.count("*").alias("warm_up"), F.count_if(F.coalesce(ok, F.lit(False))).alias("warm_up_ok")), df.where(~warm)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, for comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
