"""Writers. Each plan is run once: side outputs are written from a table that has been materialised."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialize


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON record a line, UTF-8, nulls kept; in the order of a column, over all files, if one is named."""
    (df.orderBy(order) if order else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, of an empty table too."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_pretty_json(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small summary as one indented JSON file, on whatever store the path names; more than ``most`` rows are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: use write_jsonl")
    context = rows.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps([r.asDict(True) for r in found], indent=2, default=str, ensure_ascii=False).encode("utf-8")))
    finally:
        out.close()


def union_summaries(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts under the union of their columns, in order of first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_scored(scored: DataFrame, results: str, unscorable: str, order: str | None = None) -> None:
    """All results, by ``order`` (the example's index) if given, and those that could not be scored once more on their own if there are any."""
    kept = materialize(scored, "scored")
    write_jsonl(kept, results, order)
    side = kept.where(~F.col("scorable"))
    if not side.isEmpty():
        write_jsonl(side, unscorable, order)


def write_teacher_outputs(rows: DataFrame, paths: Sequence[str]) -> None:
    """The same rows, failed ones included, to several places."""
    kept = materialize(rows, "teacher")
    for path in paths:
        write_jsonl(kept, path)


def write_runs(df: DataFrame, path: str) -> None:
    """Parquet in a folder for each kind, role and day of the run."""
    df.withColumn("run_day", F.to_date("run_ts")).write.mode("append").partitionBy("kind", "role", "run_day").parquet(path)
