"""Routing between a small and a large model, replayed over recorded responses.

A policy takes the joined responses (``student_*`` and ``teacher_*`` columns of one prompt) and adds
``selected_model``, ``routed_latency_ms``, ``confidence`` and ``reason``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.latency import percentiles
from tallyforge.registry import Registry

THRESHOLD, TIMEOUT_MS = 0.70, 10_000.0
POLICIES: Registry[Callable[..., DataFrame]] = Registry("policy")


def paired(teacher: DataFrame, student: DataFrame, on: Sequence[str], columns: Sequence[str] = ("latency_ms", "error")) -> DataFrame:
    """Every request of ``teacher`` with the student's response to it, as ``teacher_*`` and ``student_*``.

    A request the student has no response to keeps nulls and the error ``no response``, so every policy escalates it.
    """
    ours = student.select(*on, *[F.col(c).alias(f"student_{c}") for c in columns if c != "error"], F.col("error").alias("_error"), F.lit(True).alias("_there"))
    theirs = teacher.select(*on, *[F.col(c).alias(f"teacher_{c}") for c in columns if c in teacher.columns])
    return theirs.join(ours, list(on), "left").withColumn("student_error", F.when(F.col("_there"), F.col("_error")).otherwise("no response")).drop("_error", "_there")


def _routed(df: DataFrame, to_student: Column, escalated: Column, confidence: Column, reason: tuple[str, str]) -> DataFrame:
    keep = F.coalesce(to_student, F.lit(False))
    return df.select(
        "*",
        F.when(keep, "student").otherwise("teacher").alias("selected_model"),
        F.when(keep, F.col("student_latency_ms")).otherwise(escalated).alias("routed_latency_ms"),
        confidence.cast("double").alias("confidence"),
        F.when(keep, reason[0]).otherwise(reason[1]).alias("reason"),
    )


@POLICIES.register("always_teacher")
def always_teacher(df: DataFrame) -> DataFrame:
    return _routed(df, F.lit(False), F.col("teacher_latency_ms"), F.lit(None), ("", "always_teacher"))


@POLICIES.register("cascading")
def cascading(df: DataFrame, timeout_ms: float = TIMEOUT_MS, count_student: bool = False) -> DataFrame:
    """The student unless it failed or took too long; ``count_student`` adds its time to an escalated request's."""
    ok = F.col("student_error").isNull() & (F.col("student_latency_ms") <= timeout_ms)
    wasted = F.coalesce("student_latency_ms", F.lit(0.0)) if count_student else F.lit(0.0)
    return _routed(df, ok, F.col("teacher_latency_ms") + wasted, F.lit(None), ("student_ok", "student_failed_or_slow"))


@POLICIES.register("confidence")
def by_confidence(df: DataFrame, threshold: float = THRESHOLD, confidence: str = "student_confidence", count_student: bool = True) -> DataFrame:
    """The student if its confidence reaches the threshold; an escalated request took both models' time."""
    wasted = F.coalesce("student_latency_ms", F.lit(0.0)) if count_student else F.lit(0.0)
    return _routed(df, F.col(confidence) >= threshold, F.col("teacher_latency_ms") + wasted, F.col(confidence), ("confident", "low_confidence"))


def route(df: DataFrame, policy: str, **options: object) -> DataFrame:
    return POLICIES[policy](df, **options)


def shares(routed: DataFrame, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """How many requests each model got, and the latency of the whole (percentiles as in ``latency.percentiles``)."""
    at = percentiles(F.col("routed_latency_ms"), accuracy)
    return routed.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("selected_model") == "teacher").alias("teacher"),
        F.count_if(F.col("selected_model") != "teacher").alias("student"),
        F.avg("routed_latency_ms").alias("latency_mean"),
        *[F.try_element_at(at, F.lit(k + 1)).alias(f"latency_p{p}") for k, p in enumerate((50, 95, 99))],
    )


def sweep(df: DataFrame, thresholds: Sequence[float], confidence: str = "student_confidence") -> DataFrame:
    """Routed shares and mean latency at each threshold, in one pass: every row is repeated once a threshold."""
    rows = df.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    kept = F.coalesce(F.col(confidence) >= F.col("threshold"), F.lit(False))
    took = F.when(kept, F.col("student_latency_ms")).otherwise(F.col("teacher_latency_ms") + F.coalesce("student_latency_ms", F.lit(0.0)))
    return rows.groupBy("threshold").agg(F.count("*").alias("total"), F.count_if(kept).alias("student"), F.avg(took).alias("latency_mean"))
