"""Accuracy with answers that could not be scored kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import choice, latex, numbers
from tallyforge.functions.text import strip


def overall(df: DataFrame, by: Sequence[str] = (), correct: str = "correct", scorable: str = "scorable") -> DataFrame:
    """Counts and accuracy over the scorable rows, by ``by``.

    A null ``scorable`` counts as true, a null ``correct`` as false. ``accuracy`` is 0 without scorable rows;
    ``accuracy_all`` is over all rows, so groups with different shares of unscorable answers compare.
    """
    can = F.coalesce(F.col(scorable), F.lit(True))
    right = can & F.coalesce(F.col(correct), F.lit(False))
    n, ok, k = F.count("*"), F.count_if(right), F.count_if(can)
    share = F.coalesce(F.try_divide(ok, k), F.lit(0.0))
    return df.groupBy(*by).agg(
        n.alias("total_examples"),
        k.alias("scorable_examples"),
        (n - k).alias("unscorable_examples"),
        ok.alias("correct"),
        (k - ok).alias("incorrect"),
        F.round(share, 6).alias("accuracy"),
        F.round(share * 100, 2).alias("accuracy_pct"),
        F.round(F.coalesce(F.try_divide(ok, n), F.lit(0.0)), 6).alias("accuracy_all"),
    )


def by_category(df: DataFrame, category: str = "category", blank: str = "arc-challenge") -> DataFrame:
    """Correct answers of *all* rows of each category, unscorable ones included, by name; null and empty categories share one."""
    name = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit(blank))
    right = F.count_if(F.coalesce("correct", F.lit(False)))
    return df.groupBy(name.alias("category")).agg(right.alias("correct"), F.count("*").alias("total"), F.round(100 * right / F.count("*"), 2).alias("accuracy_pct")).orderBy("category")


def by_source(df: DataFrame, source: str = "source_dataset") -> DataFrame:
    """Correct answers of the *scorable* rows of each source, by name."""
    can = F.coalesce("scorable", F.lit(True))
    right = F.count_if(can & F.coalesce("correct", F.lit(False)))
    return df.groupBy(source).agg(
        right.alias("correct"),
        F.count_if(can).alias("scorable"),
        F.count("*").alias("total"),
        F.round(F.coalesce(F.try_divide(100 * right, F.count_if(can)), F.lit(0.0)), 2).alias("accuracy_pct"),
    ).orderBy(source)


def score_numeric(df: DataFrame, response: str, reference: str, error: str, lenient: bool = False) -> DataFrame:
    """Adds ``predicted_answer``, ``scorable`` and ``correct``: the number after the marker against the reference."""
    pattern = numbers.FINAL_NUMBER_LENIENT if lenient else numbers.FINAL_NUMBER
    found = F.when(F.coalesce(F.col(error), F.lit("")) == "", numbers.last_match(F.col(response), pattern))
    out = df.withColumn("predicted_answer", found).withColumn("scorable", F.col("predicted_answer").isNotNull())
    return out.withColumn("correct", F.col("scorable") & numbers.number_match(F.col("predicted_answer"), F.col(reference)))


def score_boxed(df: DataFrame, response: str, reference: str, error: str, reference_is_boxed: Column | None = None) -> DataFrame:
    """Adds the boxed prediction, ``ambiguity_reason`` (error, no box, or a reference without one) and the verdict."""
    boxed = F.lit(True) if reference_is_boxed is None else reference_is_boxed
    out = df.withColumn("predicted_answer", F.when(F.coalesce(F.col(error), F.lit("")) == "", latex.boxed_answer(F.col(response))))
    reason = F.when(F.col(error) != "", F.concat(F.lit("request_error: "), F.col(error))).when(F.col("predicted_answer").isNull(), "no_boxed_answer_in_response").when(~boxed, "reference_not_boxed")
    out = out.withColumn("ambiguity_reason", reason).withColumn("scorable", F.col("ambiguity_reason").isNull())
    return out.withColumn("correct", F.col("scorable") & latex.math_match(F.col("predicted_answer"), F.col(reference)))


def score_first_choice(df: DataFrame, response: str, reference: str, error: str, strict: bool = False) -> DataFrame:
    """Adds the first stated letter and the verdict against the reference letter."""
    out = df.withColumn("predicted_answer", F.when(F.coalesce(F.col(error), F.lit("")) == "", choice.first_choice(F.col(response), strict)))
    out = out.withColumn("scorable", F.col("predicted_answer").isNotNull())
    return out.withColumn("correct", F.col("scorable") & F.coalesce(F.col("predicted_answer") == F.col(reference), F.lit(False)))


def score_mixed(df: DataFrame, response: str, reference: str, answer_type: str, strict: bool = False) -> DataFrame:
    """Letters (the last stated) for multiple choice, numbers or expressions for free text; an empty response is unscorable."""
    text = F.nullif(F.col(response), F.lit(""))
    multiple = F.col(answer_type) == "multiple_choice"
    out = df.withColumn("predicted_answer", F.when(multiple, choice.last_choice(text, strict)).otherwise(strip(text)))
    out = out.withColumn("scorable", F.col("predicted_answer").isNotNull() & text.isNotNull())
    same = F.when(multiple, F.col("predicted_answer") == F.upper(reference)).otherwise(
        numbers.number_match(F.col("predicted_answer"), F.col(reference)) | latex.math_match(F.when(~multiple, F.col("predicted_answer")), F.when(~multiple, F.col(reference)))
    )
    return out.withColumn("correct", F.col("scorable") & F.coalesce(same, F.lit(False)))


def answer_types(df: DataFrame, reference: str) -> DataFrame:
    """How many references are one letter, and how many are not."""
    kind = choice.answer_type(F.col(reference))
    return df.agg(F.count_if(kind == "multiple_choice").alias("multiple_choice"), F.count_if(kind != "multiple_choice").alias("free_text"))
