"""Comparison of runs: repetitions, speed-ups, differences to a baseline, the latest of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repetitions(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Number of runs, mean and sample standard deviation of each metric; one run has no deviation (null)."""
    return df.groupBy(*by).agg(F.count("*").alias("reps"), *[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))])


def against(df: DataFrame, role: str, baseline: str, on: Sequence[str], metric: str) -> DataFrame:
    """Each row's ``ratio`` and ``difference`` to the baseline role's row of the same keys; null where there is none.

    ``df`` has one row for each role and keys. Without keys the baseline is one value; several are an error.
    """
    base = df.where(F.col(role) == baseline).select(*on, F.col(metric).alias("_base"))
    if not on:
        # one row always: null without a baseline, an error where there are several
        base = base.agg(F.when(F.count("*") > 1, F.raise_error(F.lit(f"several rows of {baseline!r}: name the keys"))).otherwise(F.first("_base")).alias("_base"))
    joined = df.join(base, list(on), "left") if on else df.join(F.broadcast(base), how="left")
    return joined.withColumn("ratio", F.try_divide(F.col(metric), F.col("_base"))).withColumn("difference", F.col(metric) - F.col("_base")).drop("_base")


def latest(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The columns of the row with the greatest order in each group; of ties the greatest values, so it is one row always."""
    kept = [c for c in columns if c != order]
    top = F.max(F.struct(F.col(order), *[F.col(c) for c in kept])).alias("_top")
    return df.groupBy(*by).agg(top).select(*by, F.col(f"_top.{order}").alias(order), *[F.col(f"_top.{c}").alias(c) for c in kept])
