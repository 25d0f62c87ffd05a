"""Readers of records, prompts, benchmark outputs, run folders and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge import schemas
from tallyforge.functions.text import strip


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON record a line; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_prompts_lenient(spark: SparkSession, path: str) -> DataFrame:
    """``prompt`` of each line: the field of a JSON object that has it, else the line itself; blank lines dropped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")
    parsed = F.from_json("value", "prompt string", {"mode": "PERMISSIVE"})
    return lines.select(F.coalesce(parsed["prompt"], F.col("value")).alias("prompt"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``prompt`` of each JSON line; a line without it is an error."""
    rows = read_jsonl(spark, path, "prompt string")
    return rows.select(F.when(F.col("prompt").isNull(), F.raise_error(F.lit("a line has no prompt"))).otherwise(F.col("prompt")).alias("prompt"))


def read_extra_prompts(spark: SparkSession, path: str | None) -> DataFrame:
    """Optional prompts as ``id, benchmark, prompt``: no path or no file, here or on a remote store, gives none. The id has the
    file's raw line number, from 0, blank lines counted; the file is read in one piece to number its lines. A line that is no JSON
    object is an error; one without the field gives an empty prompt."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], schemas.PROMPT)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).select("n", strip(F.col("line")).alias("line")).where("line <> ''")
    prompt = F.coalesce(F.from_json("line", "prompt string", {"mode": "FAILFAST"})["prompt"], F.lit(""))
    return lines.select(F.concat(F.lit("extra-"), F.col("n").cast("string")).alias("id"), F.lit("extra").alias("benchmark"), prompt.alias("prompt"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def read_json_result(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark's JSON result under the names this library uses; unknown keys pass."""
    return rename_result(spark.read.option("multiLine", True).json(path))


#: A benchmark tool's JSON keys, and our names.
RESULT_NAMES = {
    "completed": "completed_requests", "duration": "total_time_s", "request_throughput": "request_throughput_rps",
    "input_throughput": "input_throughput_tps", "output_throughput": "output_throughput_tps",
}


def rename_result(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RESULT_NAMES)


#: Lines of a benchmark tool's printed summary, by the names of the published results ...
STDOUT_KEYS = {
    "completed_requests": r"Successful requests:\s+(\d+)",
    "total_time_s": r"Benchmark duration \(s\):\s+([\d.]+)",
    "request_throughput_rps": r"Request throughput \(req/s\):\s+([\d.]+)",
    "input_throughput_tps": r"Input token throughput \(tok/s\):\s+([\d.]+)",
    "output_throughput_tps": r"Output token throughput \(tok/s\):\s+([\d.]+)",
    "mean_ttft_ms": r"Mean TTFT \(ms\):\s+([\d.]+)",
    "p99_ttft_ms": r"P99 TTFT \(ms\):\s+([\d.]+)",
    "mean_tpot_ms": r"Mean TPOT \(ms\):\s+([\d.]+)",
    "p99_tpot_ms": r"P99 TPOT \(ms\):\s+([\d.]+)",
    "mean_itl_ms": r"Mean ITL \(ms\):\s+([\d.]+)",
    "p99_itl_ms": r"P99 ITL \(ms\):\s+([\d.]+)",
}
#: ... and those it prints beside them.
STDOUT_MORE = {
    "failed_requests": r"Failed requests:\s+(\d+)",
    "total_input_tokens": r"Total input tokens:\s+(\d+)",
    "total_generated_tokens": r"Total generated tokens:\s+(\d+)",
    "peak_output_throughput_tps": r"Peak output token throughput \(tok/s\):\s+([\d.]+)",
    "peak_concurrent_requests": r"Peak concurrent requests:\s+([\d.]+)",
    "total_throughput_tps": r"Total [tT]oken throughput \(tok/s\):\s+([\d.]+)",
    "median_ttft_ms": r"Median TTFT \(ms\):\s+([\d.]+)",
    "median_tpot_ms": r"Median TPOT \(ms\):\s+([\d.]+)",
    "median_itl_ms": r"Median ITL \(ms\):\s+([\d.]+)",
}


def parse_keys(text: Column, keys: dict[str, str]) -> list[Column]:
    """The first match of each pattern: an integer where the pattern has only digits, else a double; null without a match."""
    return [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("bigint" if p.endswith(r"(\d+)") else "double").alias(k) for k, p in keys.items()]


def parse_stdout(df: DataFrame, text: str = "value", more: bool = True) -> DataFrame:
    """One row of metrics for each text of a tool's whole output; a failed run has nulls only."""
    return df.select(*[c for c in df.columns if c != text], *parse_keys(F.col(text), STDOUT_KEYS | (STDOUT_MORE if more else {})))


def read_stdout(spark: SparkSession, path: str) -> DataFrame:
    return parse_stdout(spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path")))


#: Fixed value: a run's folder, as kind, role and time in UTC.
RUN_FOLDER = r"/([a-z_]+(?:-gen)?)-(?:([a-z_]+)-)?(\d{8}T\d{6}Z)/"


def run_of(path: Column) -> list[Column]:
    """``kind``, ``role`` and ``run_ts`` from a file's path; null where it lies in no run's folder."""
    part = [F.nullif(F.regexp_extract(path, RUN_FOLDER, k), F.lit("")) for k in (1, 2, 3)]
    return [part[0].alias("kind"), part[1].alias("role"), F.try_to_timestamp(part[2], F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("run_ts")]


def read_runs(spark: SparkSession, root: str, file: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The named JSON file of every run below ``root``, with the run's kind, role and time."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", file)
    rows = (reader.schema(schema) if schema else reader).json(root)
    return rows.select("*", *run_of(F.col("_metadata.file_path")))


def parse_json_log(df: DataFrame, text: str = "value") -> DataFrame:
    """``ts`` (as loggers print it, or ISO), ``level, logger, message`` and all other fields as a map; lines that are no JSON objects are dropped."""
    fields = F.from_json(F.col(text), "map<string,string>")
    rows = df.where(strip(F.col(text)).startswith("{")).select(fields.alias("f")).where("f IS NOT NULL AND f['message'] IS NOT NULL")
    known = ("ts", "level", "logger", "message")
    return rows.select(
        F.coalesce(F.try_to_timestamp(F.col("f")["ts"], F.lit("yyyy-MM-dd HH:mm:ss,SSS")), F.col("f")["ts"].try_cast("timestamp")).alias("ts"),
        *[F.col("f")[k].alias(k) for k in known[1:]],
        F.map_filter("f", lambda k, v: ~k.isin(*known)).alias("extra"),
    )


#: Figures of a serving engine's periodic log line.
SERVER_KEYS = {
    "prompt_tps": r"Avg prompt throughput: ([\d.]+) tokens/s", "generation_tps": r"Avg generation throughput: ([\d.]+) tokens/s",
    "running": r"Running: (\d+)", "waiting": r"Waiting: (\d+)", "cache_usage_pct": r"cache usage: ([\d.]+)%", "prefix_hit_pct": r"Prefix cache hit rate: ([\d.]+)%",
}


def parse_server_log(df: DataFrame, text: str = "value") -> DataFrame:
    """Throughput, queue and cache figures of the engine's log lines; colours are stripped, other lines dropped."""
    plain = F.regexp_replace(F.col(text), "\\x1b?\\[[0-9;]*m", "")
    rows = df.select(*[c for c in df.columns if c != text], plain.alias("_line")).where(F.col("_line").contains("throughput:"))
    return rows.select("*", F.nullif(F.regexp_extract("_line", r"(\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.lit("")).alias("at"), *parse_keys(F.col("_line"), SERVER_KEYS)).drop("_line")


def parse_training_log(df: DataFrame, text: str = "value") -> DataFrame:
    """Steps and final figures of a trainer's printed dictionaries, wherever in a line they stand; other lines dropped."""
    lines = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\{'[a-z_]+':[^{}]*\})"), F.lit(1))).alias(text))
    fields = "loss double, grad_norm double, learning_rate double, epoch double, train_runtime double, train_samples_per_second double, train_steps_per_second double, train_loss double"
    return lines.select(F.from_json(F.replace(F.trim(text), F.lit("'"), F.lit('"')), fields).alias("f")).select("f.*")


