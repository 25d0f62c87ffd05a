"""Queries of the training-data problems, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import evalleak, packing, pairs, percentiles, reqsketch, subjects, truncation
from tallyforge.session import materialize, table


def latencies(spark: SparkSession, d: str) -> DataFrame:
    """``latency_ms`` under every key it is asked for by: benchmark, run and the whole table; by day in any case."""
    teacher = table(spark, d, "teacher_outputs").select(
        F.lit("teacher_outputs").alias("table_name"),
        F.array(
            F.struct(F.lit("benchmark").alias("dim"), F.lower(F.trim("benchmark")).alias("key")),
            F.struct(F.lit("run_id").alias("dim"), F.col("run_id").alias("key")),
        ).alias("keys"),
        F.to_date("generated_at").alias("day"),
        "latency_ms",
    )
    unscorable = table(spark, d, "gsm8k_unscorable").select(
        F.lit("gsm8k_unscorable").alias("table_name"), F.array(F.struct(F.lit("run_id").alias("dim"), F.col("run_id").alias("key"))).alias("keys"), F.to_date("evaluated_at").alias("day"), "latency_ms"
    )
    return teacher.unionByName(unscorable).select("table_name", F.explode("keys").alias("k"), "day", "latency_ms").select("table_name", "k.dim", "k.key", "day", "latency_ms")


def daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The latency sketches of every key and day, as they could be stored day by day."""
    return materialize(percentiles.sketch(latencies(spark, d), ["table_name", "dim", "key", "day"], "latency_ms"), "daily-sketches")


def over_days(daily: DataFrame) -> DataFrame:
    """Percentiles from daily sketches put together: by benchmark and run over all days, and by day over all runs."""
    over_time = percentiles.merge(daily, ["table_name", "dim", "key"])
    # each row has one run, so the days of all runs make the days of the table
    by_day = percentiles.merge(daily.where("dim = 'run_id'").select("table_name", F.lit("day").alias("dim"), F.col("day").alias("key"), "part", "n_null", "n_nan", "n_values", "sketch"), ["table_name", "dim", "key"])
    return percentiles.percentiles(over_time.unionByName(by_day), ["table_name", "dim", "key"])


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Of every benchmark, run and day; and of every benchmark and run on each day, where ``on_day`` is not null."""
    daily = daily_sketches(spark, d)
    each_day = percentiles.percentiles(daily, ["table_name", "dim", "key", "day"]).select("table_name", "dim", "key", F.coalesce("day", F.lit("unknown")).alias("on_day"), "n_null", "n_nan", "n_values", "share", "value")
    return each_day.unionByName(over_days(daily).withColumn("on_day", F.lit(None).cast("string")))


#: Groups up to this number are sent to every task; more are joined by a shuffle.
GROUPS_BROADCAST = 500_000


def p1_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile of ``p1_percentiles``, of single days and merged over them, is within the stated error, against the exact ranks of all rows."""
    rows = latencies(spark, d).withColumn("on_day", F.coalesce(F.col("day").cast("string"), F.lit("unknown")))
    merged = rows.withColumn("on_day", F.lit(None).cast("string"))
    days = merged.where("dim = 'run_id'").select("table_name", F.lit("day").alias("dim"), F.col("day").cast("string").alias("key"), "on_day", "latency_ms")
    keys = ["table_name", "dim", "key", "on_day"]
    values = rows.select(*keys, "latency_ms").unionByName(merged.select(*keys, "latency_ms")).unionByName(days).where("latency_ms IS NOT NULL AND NOT isnan(latency_ms)")
    found = p1_percentiles(spark, d).where("n_values > 0")
    one = materialize(found.groupBy(*keys).agg(F.first("n_values").alias("n_values"), F.sort_array(F.collect_list(F.struct("share", "value"))).alias("p")), "found")
    small = F.broadcast(one) if one.count() <= GROUPS_BROADCAST else one
    on = (values["table_name"] == one["table_name"]) & (values["dim"] == one["dim"]) & values["key"].eqNullSafe(one["key"]) & values["on_day"].eqNullSafe(one["on_day"])
    ranks = [F.struct(F.count_if(values["latency_ms"] < F.col("p")[k]["value"]).alias("below"), F.count_if(values["latency_ms"] <= F.col("p")[k]["value"]).alias("upto")) for k in range(len(percentiles.SHARES))]
    counted = values.join(small, on).groupBy(*[one[k] for k in keys], "n_values").agg(F.array(*ranks).alias("r"))
    # the exact rank lies between the ranks of the value's first and last occurrence
    n, wanted = F.col("n_values"), [F.ceil(F.col("n_values") * s - 1e-9) for s in percentiles.SHARES]
    off = [F.greatest(F.lit(0), F.col("r")[k]["below"] + 1 - w, w - F.col("r")[k]["upto"]) for k, w in enumerate(wanted)]
    within = [o <= F.greatest(F.lit(1.0), reqsketch.ERROR * (n - w)) for o, w in zip(off, wanted)]
    return counted.select(*keys, "n_values", *[x.alias(f"p{s * 100:g}".replace(".", "_") + "_within") for x, s in zip(within, percentiles.SHARES)])


def stored_texts(spark: SparkSession, d: str) -> DataFrame:
    teacher = table(spark, d, "teacher_outputs").select(F.lit("teacher_outputs").alias("table_name"), "row_id", "run_id", F.col("teacher_completion").alias("text"))
    unscorable = table(spark, d, "gsm8k_unscorable").select(F.lit("gsm8k_unscorable").alias("table_name"), "row_id", "run_id", F.col("model_response").alias("text"))
    return teacher.unionByName(unscorable)


def prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teacher_outputs").select(F.col("prompt").alias("text")).unionByName(table(spark, d, "gsm8k_unscorable").select(F.col("question").alias("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(stored_texts(spark, d), prompts(spark, d)).where("truncated").select("table_name", "row_id")


def p2_run_share(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares(truncation.truncated(stored_texts(spark, d), prompts(spark, d)))


def teacher_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teacher_outputs").select("row_id", "prompt", F.col("teacher_completion").alias("completion"))


def teacher_defects(spark: SparkSession, d: str) -> DataFrame:
    """Defects of ``teacher_outputs``; truncation is decided over both tables, as in ``p2_found``."""
    verdicts = truncation.truncated(stored_texts(spark, d), prompts(spark, d)).where(F.col("table_name") == "teacher_outputs")
    return pairs.defects(teacher_pairs(spark, d), verdicts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return teacher_defects(spark, d).where("defect IS NOT NULL").select("row_id", "defect")


def p3_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every defect that applies, not only the first."""
    return teacher_defects(spark, d).select("row_id", F.explode("defects").alias("defect"))


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of the largest configured length (2048)."""
    capacity = table(spark, d, "train_config").agg(F.max("max_seq_length")).collect()[0][0]
    return packing.sequences(packing.stretches(packing.sized(table(spark, d, "documents"))), capacity)


def p4_unused(spark: SparkSession, d: str) -> DataFrame:
    """Unused share for every configured length."""
    placed = packing.stretches(packing.sized(table(spark, d, "documents")))
    out = None
    for row in table(spark, d, "train_config").orderBy("config_name").collect():  # a fixed table of three rows
        one = packing.unused(packing.sequences(placed, row["max_seq_length"]), row["max_seq_length"]).withColumn("config_name", F.lit(row["config_name"]))
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return evalleak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p5_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """For each item that leaked: the documents that carry it and the largest share of it in one."""
    found = evalleak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.round(F.max("coverage"), 6).alias("max_coverage"))


def assigned_subjects(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    documents = table(spark, d, "documents")
    return subjects.assign(documents, subjects.train(documents, table(spark, d, "subject_labels"), table(spark, d, "subjects")), keep)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return assigned_subjects(spark, d).select("doc_id", F.explode("subjects").alias("subject"))


def p6_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(assigned_subjects(spark, d, ("source",)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_percentiles": p1_percentiles,
        "p1_rank_error": p1_rank_error,
        "p2_found": p2_found,
        "p2_run_share": p2_run_share,
        "p3_found": p3_found,
        "p3_defects": p3_defects,
        "p4_sequences": p4_sequences,
        "p4_unused": p4_unused,
        "p5_found": p5_found,
        "p5_leaked_items": p5_leaked_items,
        "p6_found": p6_found,
        "p6_composition": p6_composition,
    }


#: Exact counts and ranks of all rows; the sketch must be within its bound everywhere.
_P1_ROWS = """
WITH keyed AS (
  SELECT 'teacher_outputs' AS table_name, 'benchmark' AS dim, lower(trim(benchmark)) AS key, strftime(generated_at, '%Y-%m-%d') AS on_day, latency_ms FROM teacher_outputs
  UNION ALL SELECT 'teacher_outputs', 'run_id', run_id, strftime(generated_at, '%Y-%m-%d'), latency_ms FROM teacher_outputs
  UNION ALL SELECT 'gsm8k_unscorable', 'run_id', run_id, strftime(evaluated_at, '%Y-%m-%d'), latency_ms FROM gsm8k_unscorable),
every AS (
  SELECT * FROM keyed UNION ALL SELECT table_name, dim, key, NULL, latency_ms FROM keyed
  UNION ALL SELECT table_name, 'day', on_day, NULL, latency_ms FROM keyed WHERE dim = 'run_id')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_rank_error": _P1_ROWS
        + """
SELECT table_name, dim, key, on_day, count(*) AS n_values, true AS p50_within, true AS p90_within, true AS p95_within, true AS p99_within, true AS p99_9_within
FROM every WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) GROUP BY ALL
""",
    }
