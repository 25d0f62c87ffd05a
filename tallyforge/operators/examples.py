"""Evaluation examples from raw benchmark rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import choice, latex, numbers
from tallyforge.functions.text import strip
from tallyforge.operators import prompts


def numeric_examples(raw: DataFrame) -> DataFrame:
    """``question, reference_answer, full_solution`` of rows whose answer ends in a marked number."""
    return raw.select("question", numbers.first_match_or_all(F.col("answer")).alias("reference_answer"), F.col("answer").alias("full_solution"))


def boxed_examples(raw: DataFrame) -> DataFrame:
    """The last box of the solution as reference, else the whole solution, and which it was."""
    boxed = latex.boxed_answer(F.col("solution"))
    rows = raw.select("problem", "level", "type", F.col("solution").alias("full_solution"), boxed.alias("_boxed"))
    return rows.select("problem", "level", "type", "full_solution", F.coalesce(F.nullif("_boxed", F.lit("")), strip(F.col("full_solution"))).alias("reference_answer"), F.col("_boxed").isNotNull().alias("reference_is_boxed"))


def choice_examples(raw: DataFrame) -> DataFrame:
    """Question, options as lines, and the reference letter; numeric labels become letters."""
    labels = F.transform("choices.label", lambda x: choice.normal_label(x))
    category = F.col("category") if "category" in raw.columns else F.lit(None).cast("string")
    return raw.select("id", "question", prompts.options_block(labels, F.col("choices.text")).alias("options"), choice.normal_label(F.col("answerKey")).alias("reference_answer"), category.alias("category"))


def mixed_examples(raw: DataFrame) -> DataFrame:
    """Prompt, reference, its type and source from whichever of the known columns the table has; empty prompts dropped."""
    rows = raw.select(
        prompts.first_present(raw, prompts.PROMPT_FIELDS, "").cast("string").alias("prompt"),
        strip(F.coalesce(prompts.first_present(raw, prompts.ANSWER_FIELDS, "").cast("string"), F.lit(""))).alias("_answer"),
        prompts.first_present(raw, prompts.SOURCE_FIELDS, "unknown").cast("string").alias("source_dataset"),
    )
    kind = choice.answer_type(F.col("_answer"))
    return prompts.drop_empty(rows, "prompt").select("prompt", F.when(kind == "multiple_choice", F.upper("_answer")).otherwise(F.col("_answer")).alias("reference_answer"), kind.alias("answer_type"), "source_dataset")


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by an order; all for none, 0 or less."""
    return df.orderBy(order).limit(n) if n and n > 0 else df


def with_responses(examples: DataFrame, responses: DataFrame, on: Sequence[str] = ("benchmark", "index")) -> DataFrame:
    """Every example with its recorded response (``text, latency_ms, error``): the rows a scorer takes.

    An example without a response keeps nulls and the error ``no response``, so it is unscorable rather than lost. Null keys match
    nothing. Several responses to one example, of several models say, give a row each.
    """
    recorded = responses.select(*on, *[c for c in responses.columns if c not in on and c not in examples.columns and c != "error"], F.col("error").alias("_error"), F.lit(True).alias("_there"))
    error = F.when(F.col("_there"), F.col("_error")).otherwise("no response")
    return examples.join(recorded, list(on), "left").withColumn("error", error).drop("_error", "_there")
