"""Prompts and training examples: fields, templates, ids, unions and gates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import materialize

#: Names under which sources keep prompt, answer and source, in order of preference.
PROMPT_FIELDS = ("query", "prompt", "question", "input")
ANSWER_FIELDS = ("correct_answer", "answer", "label", "expected_answer", "gold")
SOURCE_FIELDS = ("source_dataset", "source", "dataset", "category")


def first_present(df: DataFrame, names: Sequence[str], default: object = None) -> Column:
    """The first of the columns that the table has, though its values may be null; else the default."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def preview(text: Column, n: int) -> Column:
    """The first n code points of a text, for reports; null stays null."""
    return F.substring(text, 1, n)


def drop_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column), F.lit("")) != "")


def options_block(labels: Column, texts: Column) -> Column:
    """``A) text`` a line; the longer of the two arrays is cut to the shorter."""
    lines = F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(") "), b))
    return F.array_join(lines, "\n")


def fill(template: str, **values: Column) -> Column:
    """Each ``{name}`` replaced by a column; everything else stays, doubled braces too."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def format_template(template: str, **values: Column) -> Column:
    """As ``str.format``: names in braces replaced, doubled braces made single; an unknown name is an error."""
    pieces: list[Column] = []
    for part in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if part in ("{{", "}}"):
            pieces.append(F.lit(part[0]))
        elif part.startswith("{") and part.endswith("}"):
            if part[1:-1] not in values:
                raise KeyError(part[1:-1])
            pieces.append(values[part[1:-1]])
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def number_ids(df: DataFrame, prefix: str, order: str, partition: str | None = None) -> DataFrame:
    """``prefix-i`` with i the row's rank by ``order``: the same whatever the partitioning.

    Ranks over a whole table are taken in two steps, within ranges of the order and from the ranges' counts, so no
    task sees all rows; within ``partition`` a window does. The ranges are written once with their numbers, so both steps
    see the same ones. Nulls come first; rows of equal ``order`` are numbered in any order.
    """
    if partition is not None:
        w = Window.partitionBy(partition).orderBy(order)
        return df.withColumn("id", F.concat(F.lit(prefix + "-"), F.col(partition).cast("string"), F.lit("-"), (F.row_number().over(w) - 1).cast("string")))
    ranged = materialize(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    w = Window.partitionBy("_part").orderBy(order)
    ranked = ranged.withColumn("_rank", F.row_number().over(w) - 1).join(F.broadcast(before), "_part")
    return ranked.withColumn("id", F.concat(F.lit(prefix + "-"), (F.col("_rank") + F.col("_before")).cast("string"))).drop("_part", "_rank", "_before")


def union_prompts(*parts: DataFrame) -> DataFrame:
    """``id, benchmark, prompt`` of several sources, duplicates kept."""
    return reduce(DataFrame.unionByName, [p.select("id", "benchmark", "prompt") for p in parts])


def assign_cyclic(requests: DataFrame, number: str, prompts: DataFrame, rank: str, n_prompts: int) -> DataFrame:
    """Request i gets the prompt whose rank is i modulo the number of prompts."""
    return requests.join(prompts, F.pmod(requests[number], F.lit(n_prompts)) == prompts[rank])


def trainable(df: DataFrame, completion: str = "teacher_completion", error: str = "error") -> DataFrame:
    """Rows without an error and with a non-empty completion; one of blanks only counts as non-empty."""
    return df.where(F.col(error).isNull() & (F.coalesce(F.col(completion), F.lit("")) != ""))


def generation_summary(df: DataFrame, benchmark: str = "benchmark", error: str = "error") -> DataFrame:
    """Prompts and successes of each benchmark."""
    return df.groupBy(benchmark).agg(F.count("*").alias("total"), F.count_if(F.col(error).isNull()).alias("ok"))


def gate(df: DataFrame, required: Sequence[str], completion: str, error: str, least: int = 50) -> DataFrame:
    """One row: rows, rows missing each required field, trainable rows, and whether those are enough."""
    good = F.col(error).isNull() & (F.coalesce(F.col(completion), F.lit("")) != "")
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required],
        F.count_if(good).alias("valid"),
        (F.count_if(good) >= least).alias("enough"),
    )
