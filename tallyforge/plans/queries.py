"""Queries over the test tables, one or more for each operator. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import choice, confidence, latex, numbers
from tallyforge import schemas
from tallyforge.operators import accuracy, compare, examples, latency, leakage, lineage, prompts, routing, sft
from tallyforge.session import scratch, table
from tallyforge.sources import readers, writers
from tallyforge.streaming import telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def _teacher(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "teacher_outputs").withColumn("benchmark", F.lower(F.trim("benchmark")))


# Telemetry


@query
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("request_rate", F.pmod("user_id", F.lit(5)))
    return latency.rounded(latency.summarize(events, ["request_rate"], "value", F.col("event_type") != "error"))


@query
def rate_sweep(spark: SparkSession, d: str) -> DataFrame:
    return latency.rounded(latency.rate_sweep(table(spark, d, "request_measurement"), ["run_id", "request_rate"]))


@query
def rate_sweep_strict(spark: SparkSession, d: str) -> DataFrame:
    return latency.rounded(latency.rate_sweep(table(spark, d, "request_measurement"), ["request_rate"], strict=True))


@query
def warm_up(spark: SparkSession, d: str) -> DataFrame:
    """The requests of the smallest rate as warm-up, beside the number of the others."""
    warm, rest = latency.warm_up(table(spark, d, "request_measurement"), F.col("request_rate") <= 1, F.col("error").isNull())
    return warm.crossJoin(F.broadcast(rest.agg(F.count("*").alias("measured"))))  # one row on either side


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.windowed(table(spark, d, "events"), "ts", "value", "event_type = 'error'")
    return latency.rounded(out.select("window_start", "total_requests", "failed_requests", "latency_min", "latency_max", "latency_mean"))


@query
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")


# Answers


@query
def numeric_last_match(spark: SparkSession, d: str) -> DataFrame:
    return _teacher(spark, d).select("row_id", numbers.last_match(F.col("teacher_completion")).alias("answer"))


@query
def numeric_reference(spark: SparkSession, d: str) -> DataFrame:
    return examples.numeric_examples(table(spark, d, "eval_items").select("question", F.col("solution").alias("answer"))).select("question", "reference_answer")


@query
def numeric_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gsm8k_unscorable")
    found = numbers.last_match(F.col("model_response"), numbers.FINAL_NUMBER_LENIENT)
    return rows.select("row_id", F.round(numbers.parse_number(found), 6).alias("value"), F.round(numbers.parse_number(F.col("reference_answer")), 6).alias("reference"))


@query
def numeric_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    off = F.col("l_extendedprice") * (1 + F.col("l_linenumber") * 4e-5)
    return rows.groupBy("l_linenumber").agg(F.count_if(numbers.close(off, F.col("l_extendedprice"))).alias("matched"), F.count("*").alias("total"))


@query
def boxed_answer(spark: SparkSession, d: str) -> DataFrame:
    return _teacher(spark, d).select("row_id", latex.boxed_answer(F.col("teacher_completion")).alias("answer"))


@query
def latex_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return _teacher(spark, d).select("row_id", latex.normal_form(F.col("teacher_completion")).alias("plain"))


@query
def math_match(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    stated = F.concat(F.lit("\\frac{"), size, F.lit("}{2}"))
    worth = ((F.col("p_size") + F.pmod("p_partkey", F.lit(3))) / 2).cast("string")
    return table(spark, d, "part").select("p_partkey", latex.math_match(stated, worth).alias("matches"))


@query
def choice_first(spark: SparkSession, d: str) -> DataFrame:
    return _teacher(spark, d).select("row_id", choice.first_choice(F.col("teacher_completion")).alias("letter"))


@query
def choice_last(spark: SparkSession, d: str) -> DataFrame:
    return _teacher(spark, d).select("row_id", choice.last_choice(F.col("teacher_completion")).alias("letter"))


@query
def score_first_choice(spark: SparkSession, d: str) -> DataFrame:
    scored = accuracy.score_first_choice(_teacher(spark, d).withColumn("reference", F.lit("B")), "teacher_completion", "reference", "error")
    return scored.groupBy("benchmark").agg(F.count("*").alias("total"), F.count_if("scorable").alias("scorable"), F.count_if("correct").alias("correct"))


@query
def answer_types(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.answer_types(table(spark, d, "eval_items"), "answer")


@query
def score_mixed(spark: SparkSession, d: str) -> DataFrame:
    rows = examples.mixed_examples(table(spark, d, "eval_items").select("item_id", "prompt", "answer").withColumnRenamed("item_id", "nr"))
    said = F.when(F.col("answer_type") == "multiple_choice", F.lit("I would say the answer is (B)")).otherwise(F.concat(F.col("reference_answer"), F.lit(".0")))
    scored = accuracy.score_mixed(rows.withColumn("response", said), "response", "reference_answer", "answer_type")
    return scored.groupBy("answer_type", "source_dataset").agg(F.count("*").alias("total"), F.count_if("scorable").alias("scorable"), F.count_if("correct").alias("correct"))


@query
def score_boxed(spark: SparkSession, d: str) -> DataFrame:
    scored = accuracy.score_boxed(_teacher(spark, d).withColumn("reference", F.lit("15")), "teacher_completion", "reference", "error")
    return scored.groupBy("benchmark").agg(
        F.count("*").alias("total"), F.count_if("scorable").alias("scorable"), F.count_if("correct").alias("correct"), F.count_if(F.col("ambiguity_reason") == "no_boxed_answer_in_response").alias("unboxed")
    )


# Accuracy


@query
def accuracy_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Lenient extraction rescues answers that the strict pattern left unscorable."""
    rows = table(spark, d, "gsm8k_unscorable").drop("predicted_answer", "correct", "scorable")
    return accuracy.overall(accuracy.score_numeric(rows, "model_response", "reference_answer", "error", lenient=True), ["run_id"])


@query
def accuracy_overall(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.overall(table(spark, d, "gsm8k_unscorable"))


@query
def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.by_category(_teacher(spark, d).withColumn("correct", F.col("finish_reason") == "stop"), "benchmark")


@query
def accuracy_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _teacher(spark, d).withColumn("correct", F.col("finish_reason") == "stop").withColumn("scorable", F.col("teacher_completion").isNotNull())
    return accuracy.by_source(rows, "run_id")


@query
def runs_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Runs by kind and role with subtotals (an extension)."""
    return table(spark, d, "run_meta").rollup("kind", "model_role").agg(F.count("*").alias("n_runs"), F.sum("gpu_count").alias("gpus"))


# Prompts and training data


@query
def prompt_template(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", prompts.fill("Solve. Use \\boxed{{}}.\n\nProblem: {question}\n", question=F.col("question")).alias("prompt"))


@query
def prompt_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", prompts.format_template("Solve. Use \\boxed{{}}.\n\nProblem: {question}\n", question=F.col("question")).alias("prompt"))


@query
def prompt_preview(spark: SparkSession, d: str) -> DataFrame:
    return _teacher(spark, d).select("row_id", prompts.preview(F.col("teacher_completion"), 120).alias("preview"))


@query
def options_block(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in "123"])
    return table(spark, d, "part").select("p_partkey", prompts.options_block(F.transform(labels, choice.normal_label), F.split("p_type", " ")).alias("options"))


@query
def prompt_union(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "benchmark", "prompt")
    own = prompts.number_ids(items, "item", "item_id")
    extra = prompts.number_ids(_teacher(spark, d).where("benchmark = 'extra'").select("row_id", "benchmark", "prompt"), "extra", "row_id")
    return prompts.union_prompts(own, extra)


@query
def mixed_examples(spark: SparkSession, d: str) -> DataFrame:
    return examples.mixed_examples(table(spark, d, "eval_items").select(F.col("prompt").alias("query"), "answer", F.col("benchmark").alias("category")))


@query
def head_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 items by id."""
    return examples.head(table(spark, d, "eval_items").select("item_id", "benchmark"), "item_id", 50)


@query
def cyclic_prompts(spark: SparkSession, d: str) -> DataFrame:
    items = prompts.number_ids(table(spark, d, "eval_items").select("item_id"), "p", "item_id").withColumn("rank", F.substring_index("id", "-", -1).cast("bigint"))
    n = items.count()
    return prompts.assign_cyclic(table(spark, d, "request_measurement").select("meas_id"), "meas_id", items, "rank", n).groupBy("item_id").agg(F.count("*").alias("n_requests"))


@query
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    return prompts.generation_summary(_teacher(spark, d))


@query
def trainable_rows(spark: SparkSession, d: str) -> DataFrame:
    return prompts.trainable(_teacher(spark, d)).groupBy(F.coalesce("benchmark", F.lit("?")).alias("benchmark")).agg(F.count("*").alias("valid"))


@query
def schema_gate(spark: SparkSession, d: str) -> DataFrame:
    return prompts.gate(_teacher(spark, d), ["id", "benchmark", "prompt", "teacher_completion"], "teacher_completion", "error")


@query
def train_split(spark: SparkSession, d: str) -> DataFrame:
    return sft.split(_teacher(spark, d), "id").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    ids, mask = sft.fit(F.transform(F.split("question", " "), lambda w: F.length(w)), 48)
    labels = sft.mask_labels(F.col("ids"), F.col("mask"), F.size(F.split(F.substring_index("question", ".", 1), " ")))
    rows = table(spark, d, "eval_items").select("item_id", "question", ids.alias("ids"), mask.alias("mask"))
    return rows.select("item_id", F.array_join(labels.cast("array<string>"), ",").alias("labels"), sft.fully_masked(labels).alias("fully_masked"))


@query
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "events").withColumn("role", F.when(F.col("value") < 40, "user").otherwise("assistant"))
    return sft.turn_pairs(turns.select("user_id", "event_id", "role", F.col("props").alias("text")), "user_id", "event_id", "role", "text")


@query
def leakage_exact(spark: SparkSession, d: str) -> DataFrame:
    """Documents of other sources that repeat a document of the forums."""
    documents = table(spark, d, "documents")
    forum = F.coalesce(F.lower("source").startswith("forum"), F.lit(False))
    return leakage.exact(documents.where(~forum).select("doc_id", "text"), "text", documents.where(forum).select("text"), "text").select("doc_id")


@query
def leakage_ngrams(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.containment(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "question", n=8, least=0.5)
    return found.select("doc", "item", "shared", "n_grams", F.round("containment", 6).alias("containment"))


# Confidence and routing


@query
def wording_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _teacher(spark, d).select("row_id", F.round(confidence.from_wording(F.col("teacher_completion")), 6).alias("confidence"))


@query
def logprob_confidence(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in "abcd"])
    positions = F.array(*[F.map_from_arrays(names, F.slice(F.col("embedding").cast("array<double>"), k, 4)) for k in (1, 5)])
    rows = table(spark, d, "embeddings").withColumn("positions", positions)
    return rows.select("vec_id", F.round(confidence.from_logprobs(F.col("positions"), "max_logprob"), 6).alias("peak"), F.round(confidence.from_logprobs(F.col("positions"), "entropy"), 6).alias("certainty"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """All requests of the teacher, with the student's response to the request of that number where there is one."""
    student = table(spark, d, "gsm8k_unscorable").select("row_id", "latency_ms", "error", confidence.from_wording(F.col("model_response")).alias("confidence"))
    teacher = table(spark, d, "teacher_outputs").select("row_id", F.nanvl("latency_ms", F.lit(None).cast("double")).alias("latency_ms"))
    return routing.paired(teacher, student, ["row_id"], ["latency_ms", "error", "confidence"])


@query
def paired_responses(spark: SparkSession, d: str) -> DataFrame:
    return latency.rounded(_pairs(spark, d).select("row_id", "teacher_latency_ms", "student_latency_ms", "student_error", "student_confidence"))


def _routed(df: DataFrame) -> DataFrame:
    return latency.rounded(df)


@query
def route_always_teacher(spark: SparkSession, d: str) -> DataFrame:
    return _routed(routing.shares(routing.route(_pairs(spark, d), "always_teacher"), ["reason"]))


@query
def route_cascading(spark: SparkSession, d: str) -> DataFrame:
    return _routed(routing.shares(routing.route(_pairs(spark, d), "cascading", timeout_ms=2000.0), ["reason"]))


@query
def route_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _routed(routing.shares(routing.route(_pairs(spark, d), "confidence"), ["reason"]))


@query
def route_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _routed(routing.sweep(_pairs(spark, d), [0.5, 0.7, 0.8, 0.85]))


# Runs


def _per_run(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "request_measurement").where("error IS NULL").groupBy("run_id", "request_rate").agg(F.avg("latency_ms").alias("latency"), F.sum("output_tokens").alias("tokens"))
    return runs.join(table(spark, d, "run_meta").select("run_id", "model_role"), "run_id")


@query
def repetitions(spark: SparkSession, d: str) -> DataFrame:
    return latency.rounded(compare.repetitions(_per_run(spark, d), ["model_role", "request_rate"], ["latency", "tokens"]), 4)


@query
def speedup(spark: SparkSession, d: str) -> DataFrame:
    per_role = _per_run(spark, d).groupBy("model_role", "request_rate").agg(F.avg("latency").alias("latency"))
    return latency.rounded(compare.against(per_role, "model_role", "teacher", ["request_rate"], "latency"), 4)


@query
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return compare.latest(table(spark, d, "run_meta"), ["kind", "model_role"], "timestamp_utc", ["run_id", "git_commit"])


@query
def run_folders(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/results/"), F.col("run_id"), F.lit("/run_meta.json"))
    return table(spark, d, "run_meta").select("run_id", *readers.run_of(path), lineage.text_hash(F.col("run_id")).alias("hash"))


@query
def summary_union(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "request_measurement").groupBy("run_id").agg(F.count("*").alias("n_requests"))
    answers = _teacher(spark, d).groupBy("run_id").agg(F.count("*").alias("n_answers"))
    return writers.union_summaries([requests, answers])


# Texts of tools and logs


@query
def stdout_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every printed figure; a tenth of the runs failed and printed none."""
    names = [
        "Successful requests", "Benchmark duration (s)", "Request throughput (req/s)", "Input token throughput (tok/s)", "Output token throughput (tok/s)", "Mean TTFT (ms)", "P99 TTFT (ms)", "Mean TPOT (ms)", "P99 TPOT (ms)",
        "Mean ITL (ms)", "P99 ITL (ms)", "Failed requests", "Total input tokens", "Total generated tokens", "Peak output token throughput (tok/s)", "Peak concurrent requests", "Total Token throughput (tok/s)",
        "Median TTFT (ms)", "Median TPOT (ms)", "Median ITL (ms)",
    ]
    lines = [F.concat(F.lit(f"{name}:      "), (F.col("p_size") + n).cast("string"), F.lit("" if n in (0, 11, 12, 13) else ".50")) for n, name in enumerate(names)]
    text = F.when(F.col("p_partkey") % 10 > 0, F.concat_ws("\n", *lines)).otherwise("Traceback: no server")
    return readers.parse_stdout(table(spark, d, "part").select("p_partkey", text.alias("value")))


@query
def training_log(spark: SparkSession, d: str) -> DataFrame:
    """Trainer lines wherever they stand in documents."""
    return readers.parse_training_log(table(spark, d, "documents").select("text"), "text")


@query
def server_log(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    esc = F.lit("\x1b[1;36m")
    line = F.concat(
        esc, F.lit("(Server pid=7)\x1b[0;0m INFO 03-09 08:52:"), F.lpad(F.pmod("p_partkey", F.lit(60)).cast("string"), 2, "0"), F.lit(" [loggers.py:248] Engine 000: Avg prompt throughput: "),
        F.col("p_retailprice").cast("string"), F.lit(" tokens/s, Avg generation throughput: "), size, F.lit(".5 tokens/s, Running: "), size, F.lit(" reqs, Waiting: 0 reqs, GPU KV cache usage: "), size, F.lit(".1%, Prefix cache hit rate: 9.0%"),
    )
    lines = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(line).alias("value"))
    return readers.parse_server_log(lines)


@query
def json_log(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    line = F.to_json(F.struct(at.alias("ts"), F.lit("INFO").alias("level"), F.col("event_type").alias("logger"), F.lit("done").alias("message"), F.col("user_id").alias("job_id")))
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, F.lit("plain line")).otherwise(F.concat(F.lit(" "), line)).alias("value"))
    return readers.parse_json_log(lines).select("ts", "level", "logger", "message", F.col("extra")["job_id"].cast("bigint").alias("job_id"))


@query
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query
def json_result(spark: SparkSession, d: str) -> DataFrame:
    """A tool's JSON results: known keys renamed, others kept."""
    raw = table(spark, d, "part").select(
        F.to_json(F.struct(F.col("p_size").alias("completed"), F.col("p_retailprice").alias("duration"), F.lit(2.5).alias("request_throughput"), F.col("p_partkey").alias("mean_ttft_ms"), F.col("p_brand").alias("backend"))).alias("value")
    )
    path = scratch(spark, "results")
    raw.write.text(path)
    return readers.rename_result(spark.read.json(path))


# Files written and read again


@query
def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    writers.write_jsonl(_teacher(spark, d).select("id", "benchmark", "prompt"), path)
    return readers.read_jsonl(spark, path, schemas.PROMPT)


@query
def csv_records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, d, "run_meta").select("run_id", "kind", "gpu_count"), path)
    return spark.read.option("header", True).schema("run_id STRING, kind STRING, gpu_count INT").csv(path)


@query
def summary_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "summary") + ".json"
    writers.write_pretty_json(prompts.generation_summary(_teacher(spark, d)), path)
    return spark.read.schema("benchmark STRING, total BIGINT, ok BIGINT").option("multiLine", True).json(path)


@query
def prompts_strict(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "prompts")
    table(spark, d, "eval_items").select(F.to_json(F.struct("prompt"))).write.text(path)
    return readers.read_prompts(spark, path)


@query
def prompts_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Every other line is JSON, the others are text between white space."""
    path = scratch(spark, "lenient")
    one_line = F.concat(F.lit("\t "), F.regexp_replace("question", r"\s+", " "), F.lit("\u00a0 "))
    table(spark, d, "eval_items").select(F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct("prompt"))).otherwise(one_line).alias("value")).unionByName(spark.createDataFrame([(" \t",), ("",)], "value string")).write.text(path)
    return readers.read_prompts_lenient(spark, path)


@query
def prompts_extra(spark: SparkSession, d: str) -> DataFrame:
    """One file with blank lines and lines without the field; and a file that is not there."""
    path = scratch(spark, "extra")
    line = F.when(F.col("item_id") % 7 == 0, F.lit(" \t")).when(F.col("item_id") % 11 == 0, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct("prompt")))
    table(spark, d, "eval_items").orderBy("item_id").select(line.alias("value")).coalesce(1).write.text(path)
    return readers.read_extra_prompts(spark, path).unionByName(readers.read_extra_prompts(spark, path + "-none"))


@query
def scored_files(spark: SparkSession, d: str) -> DataFrame:
    """Results in the order of their index, and the unscorable ones once more."""
    rows = table(spark, d, "gsm8k_unscorable").drop("predicted_answer", "correct", "scorable")
    scored = accuracy.score_numeric(rows, "model_response", "reference_answer", "error", lenient=True).select(F.col("row_id").alias("index"), "predicted_answer", "scorable", "correct")
    path, side = scratch(spark, "scored"), scratch(spark, "unscorable")
    writers.write_scored(scored, path, side, "index")
    fields = "index BIGINT, predicted_answer STRING, scorable BOOLEAN, correct BOOLEAN"
    return readers.read_jsonl(spark, path, fields).withColumn("file", F.lit("results")).unionByName(readers.read_jsonl(spark, side, fields).withColumn("file", F.lit("unscorable")))


@query
def teacher_files(spark: SparkSession, d: str) -> DataFrame:
    """The same rows in two places."""
    paths = [scratch(spark, "teacher-a"), scratch(spark, "teacher-b")]
    rows = table(spark, d, "teacher_outputs").select("id", "benchmark", "prompt", "teacher_completion", "teacher_model", "generation_parameters", "latency_ms", "finish_reason", "error")
    writers.write_teacher_outputs(rows, paths)
    read = [readers.read_jsonl(spark, p, schemas.TEACHER_OUTPUT).withColumn("place", F.lit(k)) for k, p in enumerate(paths)]
    return read[0].unionByName(read[1]).groupBy("place", "teacher_model").agg(F.count("*").alias("n_rows"), F.count("error").alias("failed"), F.sum("generation_parameters.max_tokens").alias("max_tokens"), F.sum(F.length("teacher_completion")).alias("chars"))


@query
def run_files(spark: SparkSession, d: str) -> DataFrame:
    """Runs in a folder for each kind, role and day, read again from there."""
    path = scratch(spark, "runs")
    runs = table(spark, d, "run_meta")
    writers.write_runs(runs.select("run_id", "seed", *readers.run_of(F.concat(F.lit("/results/"), F.col("run_id"), F.lit("/run_meta.json")))), path)
    return spark.read.parquet(path).select("run_id", "seed", "kind", "role", "run_ts", F.col("run_day").cast("date").alias("run_day"))


# Examples and their responses


@query
def boxed_examples(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select(F.col("question").alias("problem"), F.col("benchmark").alias("level"), F.col("answer").alias("type"), "solution")
    return examples.boxed_examples(items).select("problem", "level", "reference_answer", "reference_is_boxed")


@query
def choice_examples(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_type", " ")
    choices = F.struct(F.transform(words, lambda x, i: (i + 1).cast("string")).alias("label"), words.alias("text"))
    raw = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), choices.alias("choices"), (F.pmod("p_partkey", F.lit(3)) + 1).cast("string").alias("answerKey"), F.col("p_brand").alias("category"))
    return examples.choice_examples(raw)


@query
def example_responses(spark: SparkSession, d: str) -> DataFrame:
    """Recorded responses joined to their examples, scored, and broken down: where every scoring run begins and ends."""
    items = prompts.number_ids(table(spark, d, "eval_items"), "x", "item_id").select("benchmark", F.substring_index("id", "-", -1).cast("bigint").alias("index"), numbers.first_match_or_all(F.col("solution")).alias("reference_answer"))
    recorded = table(spark, d, "gsm8k_unscorable").select(F.lit("gsm8k").alias("benchmark"), F.col("example_index").alias("index"), F.col("model_response").alias("text"), "latency_ms", "error")
    scored = accuracy.score_numeric(examples.with_responses(items, recorded), "text", "reference_answer", "error", lenient=True)
    return scored.groupBy("benchmark").agg(F.count("*").alias("total"), F.count_if(F.col("error") == "no response").alias("unanswered"), F.count_if("scorable").alias("scorable"), F.count_if("correct").alias("correct"))


@query
def score_reference_not_boxed(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose reference, the whole prompt, has no box; and why each row is not scored."""
    rows = _teacher(spark, d).withColumn("reference", F.col("prompt"))
    scored = accuracy.score_boxed(rows, "teacher_completion", "reference", "error", F.col("row_id") % 2 == 0)
    return scored.groupBy(F.coalesce("ambiguity_reason", F.lit("scored")).alias("reason")).agg(F.count("*").alias("n"))


# Runs and configurations


@query
def role_resolution(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame([("teacher", "large"), ("student_mid", "mid")], "model_role string, model string")
    return lineage.resolve_role(table(spark, d, "run_meta").select("run_id", "model_role"), models)


@query
def config_merge(spark: SparkSession, d: str) -> DataFrame:
    config = lineage.deep_merge({"run": {"seed": 1, "rate": 2.5}, "kept": [1, 2]}, {"run": {"seed": 7}, "kept": [3]})
    return spark.createDataFrame([(config["run"]["seed"], config["run"]["rate"], config["kept"], lineage.config_hash(config))], "seed int, rate double, kept array<int>, config_hash string").select("seed", "rate", F.concat_ws(",", F.col("kept").cast("array<string>")).alias("kept"), "config_hash")


@query
def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What this very run's metadata hold: the driver tells whether it is there, since the values differ from run to run."""
    row = lineage.capture(spark, {"a": 1}, 42)
    return row.select("seed", "config_hash", (F.col("gpu_count") == F.size("gpus")).alias("gpus_counted"), (F.size("pip_freeze") > 0).alias("has_packages"), F.col("timestamp_utc").try_cast("timestamp").isNotNull().alias("has_time"), (F.length("hostname") > 0).alias("has_host"))


# Approximate variants, held against exact ranks


@query
def latency_summary_approx(spark: SparkSession, d: str) -> DataFrame:
    """Whether each approximate percentile of ``latency_summary`` has its rank, within 1 / accuracy of the rows."""
    events = table(spark, d, "events").withColumn("request_rate", F.pmod("user_id", F.lit(5))).where("event_type <> 'error'")
    found = latency.summarize(events, ["request_rate"], "value", F.lit(True), accuracy=1000).select("request_rate", *[F.col(f"latency_p{round(p * 100)}").alias(f"v{k}") for k, p in enumerate(latency.PERCENTILES)])
    held = events.join(F.broadcast(found), "request_rate").where("value IS NOT NULL AND NOT isnan(value)").groupBy("request_rate").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("value") < F.col(f"v{k}")).alias(f"below{k}") for k in range(3)], *[F.count_if(F.col("value") <= F.col(f"v{k}")).alias(f"upto{k}") for k in range(3)]
    )
    within = [((F.col(f"below{k}") <= F.col("n") * (p + 1e-3) + 1) & (F.col(f"upto{k}") >= F.col("n") * (p - 1e-3) - 1)).alias(f"p{round(p * 100)}_within") for k, p in enumerate(latency.PERCENTILES)]
    return held.select("request_rate", "n", *within)


@query
def distinct_users_approx(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate number of different users of each event type is within a tenth (an extension)."""
    counted = table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"))
    return counted.select("event_type", "n", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("within"))
