import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import accuracy, compare, examples, latency, leakage, lineage, prompts, routing, sft
from tallyforge.registry import Registry
from tallyforge.sources import readers, writers
from tallyforge.streaming import telemetry


def test_latency_summary(spark):
    rows = [("a", 1.0, None), ("a", 2.0, None), ("a", 10.0, None), ("a", 99.0, "boom"), ("a", None, None), ("a", float("nan"), None), ("b", 5.0, "boom")]
    df = spark.createDataFrame(rows, "k string, ms double, error string")
    found = {r["k"]: r for r in latency.summarize(df, ["k"], "ms", F.col("error").isNull()).collect()}
    assert (found["a"]["latency_p50"], found["a"]["latency_p95"], found["a"]["latency_count"]) == (2.0, pytest.approx(9.2), 3)
    assert found["a"]["latency_p99"] == pytest.approx(9.84)
    assert found["b"]["latency_p50"] is None and found["b"]["failed_requests"] == 1


def test_rate_sweep(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [("r", 1.0, 200, 100.0, 50.0, 10, None, t), ("r", 1.0, 500, 200.0, None, 5, None, t + datetime.timedelta(seconds=1)), ("r", 1.0, None, 400.0, None, 0, "x", t)]
    df = spark.createDataFrame(rows, "run_id string, request_rate double, status int, latency_ms double, ttfb_ms double, output_tokens bigint, error string, sent_at timestamp")
    row = latency.rate_sweep(df, ["run_id"]).collect()[0]
    assert (row["successful_requests"], row["total_output_tokens"], row["ttfb_count"]) == (2, 15, 1)
    assert row["effective_throughput_tps"] == pytest.approx(15 / 0.4) and row["wall_throughput_tps"] == pytest.approx(15 / 1.2)
    assert latency.rate_sweep(df, ["run_id"], strict=True).collect()[0]["successful_requests"] == 1
    assert latency.rate_sweep(df.limit(0), ["run_id"]).collect() == []


def test_accuracy(spark):
    df = spark.createDataFrame([(True, True, "c"), (False, True, ""), (True, False, "c"), (True, None, None)], "correct boolean, scorable boolean, category string")
    row = accuracy.overall(df).collect()[0]
    assert (row["total_examples"], row["scorable_examples"], row["unscorable_examples"], row["correct"], row["incorrect"]) == (4, 3, 1, 2, 1)
    assert (row["accuracy"], row["accuracy_pct"], row["accuracy_all"]) == (0.666667, 66.67, 0.5)
    assert accuracy.overall(df.where("false")).collect()[0]["accuracy"] == 0.0
    by = {r["category"]: (r["correct"], r["total"]) for r in accuracy.by_category(df).collect()}
    assert by == {"c": (2, 2), "arc-challenge": (1, 2)}
    source = {r["category"]: r["accuracy_pct"] for r in accuracy.by_source(df, "category").collect()}
    assert source == {"c": 100.0, "": 0.0, None: 100.0}


def test_scoring(spark):
    df = spark.createDataFrame([("#### 1,200", "1200", None), ("no number", "3", None), ("#### 5", "5", "timeout"), ("#### 4", "5", None)], "response string, ref string, error string")
    assert [(r["scorable"], r["correct"]) for r in accuracy.score_numeric(df, "response", "ref", "error").collect()] == [(True, True), (False, False), (False, False), (True, False)]
    boxed = spark.createDataFrame([("\\boxed{\\frac{1}{2}}", "0.5", None), ("none", "1", None), ("\\boxed{1}", "1", "late")], "response string, ref string, error string")
    assert [(r["ambiguity_reason"], r["correct"]) for r in accuracy.score_boxed(boxed, "response", "ref", "error").collect()] == [(None, True), ("no_boxed_answer_in_response", False), ("request_error: late", False)]
    letters = spark.createDataFrame([("The answer is B", "B", None), ("hm", "A", None)], "response string, ref string, error string")
    assert [(r["scorable"], r["correct"]) for r in accuracy.score_first_choice(letters, "response", "ref", "error").collect()] == [(True, True), (False, False)]
    mixed = spark.createDataFrame([("option (c)", "C", "multiple_choice"), ("1/2", "0.5", "free_text"), ("", "x", "free_text"), (None, "A", "multiple_choice"), ("red", "red", "free_text")], "response string, ref string, kind string")
    assert [(r["scorable"], r["correct"]) for r in accuracy.score_mixed(mixed, "response", "ref", "kind").collect()] == [(True, True), (True, True), (False, False), (False, False), (True, True)]


def test_prompts(spark):
    df = spark.createDataFrame([(["1", "2"], ["x", "y", "z"], "q {a}")], "labels array<string>, texts array<string>, q string")
    assert df.select(prompts.options_block(F.col("labels"), F.col("texts"))).collect()[0][0] == "1) x\n2) y"
    assert df.select(prompts.fill("a {q} {{b}}", q=F.col("q"))).collect()[0][0] == "a q {a} {{b}}"
    assert df.select(prompts.format_template("a {q} {{b}}", q=F.col("q"))).collect()[0][0] == "a q {a} {b}"
    with pytest.raises(KeyError):
        prompts.format_template("{other}", q=F.col("q"))
    rows = prompts.number_ids(spark.range(1000).select((1000 - F.col("id")).alias("k")).repartition(7), "x", "k").collect()
    assert all(r["id"] == f"x-{r['k'] - 1}" for r in rows) and len(rows) == 1000
    gate = prompts.gate(spark.createDataFrame([("1", "a", None), (None, "", None), ("2", None, "e")], "id string, c string, error string"), ["id"], "c", "error", least=1).collect()[0]
    assert (gate["total"], gate["missing_id"], gate["valid"], gate["enough"]) == (3, 1, 1, True)


def test_examples(spark):
    raw = spark.createDataFrame([("What?", "It is so. #### 12"), ("Why?", " because ")], "question string, answer string")
    assert [r["reference_answer"] for r in examples.numeric_examples(raw).collect()] == ["12", "because"]
    boxed = spark.createDataFrame([("p", "so \\boxed{3}", "l", "t"), ("p", " plain ", "l", "t")], "problem string, solution string, level string, type string")
    assert [(r["reference_answer"], r["reference_is_boxed"]) for r in examples.boxed_examples(boxed).collect()] == [("3", True), ("plain", False)]
    arc = spark.createDataFrame([("i", "q", (["1", "2"], ["x", "y"]), "2")], "id string, question string, choices struct<label:array<string>,text:array<string>>, answerKey string")
    row = examples.choice_examples(arc).collect()[0]
    assert (row["options"], row["reference_answer"], row["category"]) == ("A) x\nB) y", "B", None)
    mixed = spark.createDataFrame([("p", "b", "s"), ("", "x", "s"), ("q", None, "s")], "query string, gold string, dataset string")
    assert sorted((r["prompt"], r["reference_answer"], r["answer_type"], r["source_dataset"]) for r in examples.mixed_examples(mixed).collect()) == [("p", "B", "multiple_choice", "s"), ("q", "", "free_text", "s")]
    assert [r["id"] for r in examples.head(spark.range(10), "id", 3).collect()] == [0, 1, 2] and examples.head(spark.range(10), "id", 0).count() == 10


def test_sft(spark):
    df = spark.createDataFrame([([11, 12, 13, 14, 0], [1, 1, 1, 1, 0], 2), ([1, 2], [1, 1], 5)], "ids array<int>, mask array<int>, p int")
    labels = sft.mask_labels(F.col("ids"), F.col("mask"), F.col("p"))
    assert [r[0] for r in df.select(labels).collect()] == [[-100, -100, 13, 14, -100], [-100, -100]]
    assert [r[0] for r in df.select(sft.fully_masked(labels)).collect()] == [False, True]
    ids, mask = sft.fit(F.col("ids"), 3, 9)
    assert [(r[0], r[1]) for r in df.select(ids, mask).collect()] == [([11, 12, 13], [1, 1, 1]), ([1, 2, 9], [1, 1, 0])]
    keys = spark.range(20_000)
    held = {r["id"] for r in sft.split(keys.repartition(3), "id").where("split = 'validation'").collect()}
    assert held == {r["id"] for r in sft.split(keys.repartition(5), "id").where("split = 'validation'").collect()} and 2700 < len(held) < 3300
    assert sft.split(keys, "id", share=0).where("split = 'validation'").count() == 0
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 1, "assistant", "d")], "c int, t int, role string, text string")
    assert [tuple(r) for r in sft.turn_pairs(turns, "c", "t", "role", "text").collect()] == [(1, 1, "a", "b")]


def test_routing(spark):
    rows = [(0.70, 100.0, None, 500.0), (0.69, 100.0, None, 500.0), (None, 100.0, "x", 500.0)]
    df = spark.createDataFrame(rows, "student_confidence double, student_latency_ms double, student_error string, teacher_latency_ms double")
    assert [(r["selected_model"], r["routed_latency_ms"]) for r in routing.route(df, "confidence").collect()] == [("student", 100.0), ("teacher", 600.0), ("teacher", 600.0)]
    assert [(r["selected_model"], r["routed_latency_ms"]) for r in routing.route(df, "cascading").collect()] == [("student", 100.0), ("student", 100.0), ("teacher", 500.0)]
    assert routing.shares(routing.route(df, "always_teacher")).collect()[0]["teacher"] == 3
    assert [(r["threshold"], r["student"]) for r in routing.sweep(df, [0.5, 0.7]).orderBy("threshold").collect()] == [(0.5, 2), (0.7, 1)]
    with pytest.raises(ValueError):
        routing.route(df, "other")
    registry = Registry("thing")
    registry.register("a", 1)
    with pytest.raises(ValueError):
        registry.register("a", 2)


def test_compare(spark):
    df = spark.createDataFrame([("teacher", 1, 10.0), ("student", 1, 25.0), ("student", 2, 5.0)], "role string, rate int, rps double")
    found = {(r["role"], r["rate"]): (r["ratio"], r["difference"]) for r in compare.against(df, "role", "teacher", ["rate"], "rps").collect()}
    assert found == {("teacher", 1): (1.0, 0.0), ("student", 1): (2.5, 15.0), ("student", 2): (None, None)}
    reps = {r["role"]: r for r in compare.repetitions(df, ["role"], ["rps"]).collect()}
    assert reps["student"]["rps_mean"] == 15.0 and reps["teacher"]["rps_sd"] is None
    assert [tuple(r) for r in compare.latest(df, ["role"], "rate", ["rps"]).orderBy("role").collect()] == [("student", 2, 5.0), ("teacher", 1, 10.0)]


def test_leakage(spark):
    train = spark.createDataFrame([(1, "The Cat sat, on the mat today!"), (2, "other"), (3, None), (4, "x the cat sat on the mat y")], "id int, text string")
    test = spark.createDataFrame([(9, "the cat sat on the mat today"), (8, "")], "item int, text string")
    assert [r["id"] for r in leakage.exact(train, "text", test, "text").collect()] == [1]
    found = leakage.containment(train, "id", "text", test, "item", "text", n=3, least=0.5).orderBy("doc").collect()
    assert [(r["doc"], r["item"], r["shared"]) for r in found] == [(1, 9, 5), (4, 9, 4)]


def test_lineage(spark, tmp_path):
    assert lineage.deep_merge({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}, "d": {"e": 1}}) == {"a": {"b": 1, "c": [2]}, "d": {"e": 1}}
    path = tmp_path / "c.json"
    path.write_text("")
    assert lineage.load_config(str(path), {"x": 1}) == {"x": 1}
    with pytest.raises(FileNotFoundError):
        lineage.load_config(str(tmp_path / "none.json"))
    config = {"b": 1, "a": [1, 2]}
    assert spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "t string").select(lineage.text_hash(F.col("t"))).collect()[0][0] == lineage.config_hash(config)
    folder = lineage.run_folder(str(tmp_path), "quality", "teacher", datetime.datetime(2026, 3, 7, 14, 47, 11, tzinfo=datetime.UTC))
    assert folder.name == "quality-teacher-20260307T144711Z" and lineage.snapshot(config, folder).exists()
    assert lineage.capture(spark, config).collect()[0]["config_hash"] == lineage.config_hash(config)


STDOUT = """============ Serving Benchmark Result ============
Successful requests:                     10000
Failed requests:                         0
Benchmark duration (s):                  391.35
Request throughput (req/s):              25.55
Output token throughput (tok/s):         6541.47
Mean TTFT (ms):                          192081.41
P99 TPOT (ms):                           38.50
"""


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt": "one"}\n\nplain text\n{"other": 1}\n{broken\n')
    assert [r[0] for r in readers.read_prompts_lenient(spark, str(tmp_path / "p.jsonl")).collect()] == ["one", "plain text", '{"other": 1}', "{broken"]
    (tmp_path / "extra.jsonl").write_text('{"prompt": "a"}\n\n{"prompt": "b"}\n')
    assert [tuple(r)[0] for r in readers.read_extra_prompts(spark, str(tmp_path / "extra.jsonl")).collect()] == ["extra-0", "extra-2"]
    assert readers.read_extra_prompts(spark, str(tmp_path / "none")).collect() == [] and readers.read_extra_prompts(spark, None).collect() == []
    (tmp_path / "bad.jsonl").write_text('{"prompt": "one"}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "prompt string").collect()
    (tmp_path / "lacks.jsonl").write_text('{"x": "one"}\n')
    with pytest.raises(Exception):
        readers.read_prompts(spark, str(tmp_path / "lacks.jsonl")).collect()
    (tmp_path / "stdout.txt").write_text(STDOUT)
    row = readers.read_stdout(spark, str(tmp_path / "stdout.txt")).collect()[0]
    assert (row["completed_requests"], row["total_time_s"], row["mean_ttft_ms"], row["p99_tpot_ms"], row["input_throughput_tps"], row["failed_requests"]) == (10000, 391.35, 192081.41, 38.5, None, 0)
    folder = tmp_path / "online" / "online-student_mid-20260307T111719Z"
    folder.mkdir(parents=True)
    (folder / "r.json").write_text('{\n "completed": 5,\n "extra": "x"\n}')
    run = readers.read_runs(spark, str(tmp_path / "online"), "r.json").collect()[0]
    assert (run["kind"], run["role"], run["run_ts"], run["completed"]) == ("online", "student_mid", datetime.datetime(2026, 3, 7, 11, 17, 19), 5)
    assert readers.read_json_result(spark, str(folder / "r.json")).columns == ["completed_requests", "extra"]
    df = spark.createDataFrame([(1, "ä", True), (2, None, False)], "i int, t string, scorable boolean")
    writers.write_scored(df, str(tmp_path / "out"), str(tmp_path / "side"))
    assert readers.read_jsonl(spark, str(tmp_path / "side"), "i int, t string, scorable boolean").collect()[0]["i"] == 2
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    writers.write_pretty_json(df, str(tmp_path / "s" / "x.json"))
    assert json.loads((tmp_path / "s" / "x.json").read_text())[0]["t"] == "ä"
    assert writers.union_summaries([df.select("i"), df.select("t")]).columns == ["i", "t"]
    writers.write_teacher_outputs(df, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert readers.read_jsonl(spark, str(tmp_path / "b"), "i int").count() == 2
    writers.write_runs(df.select("i", F.lit("online").alias("kind"), F.lit("teacher").alias("role"), F.lit("2026-03-07 10:00:00").cast("timestamp").alias("run_ts")), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).where("role = 'teacher'").count() == 2


def test_logs(spark):
    lines = [
        ('{"ts": "2026-02-28 11:35:38,639", "level": "INFO", "logger": "a.b", "message": "Launching", "role": "teacher"}',),
        ("\x1b[0;36m(pid=1)\x1b[0;0m INFO 02-26 12:31:35 [loggers.py:257] Engine 000: Avg prompt throughput: 11.4 tokens/s, Avg generation throughput: 212.5 tokens/s, Running: 3 reqs, Waiting: 0 reqs, GPU KV cache usage: 0.5%, Prefix cache hit rate: 0.0%",),
        ("{'loss': 0.5992, 'grad_norm': 0.098, 'learning_rate': 0.0001, 'epoch': 0.05}",), ("noise",), (None,),
    ]
    df = spark.createDataFrame(lines, "value string")
    log = readers.parse_json_log(df).collect()
    assert len(log) == 1 and log[0]["extra"] == {"role": "teacher"} and log[0]["ts"].microsecond == 639000
    server = readers.parse_server_log(df).collect()
    assert len(server) == 1 and (server[0]["generation_tps"], server[0]["running"], server[0]["cache_usage_pct"]) == (212.5, 3, 0.5)
    steps = readers.parse_training_log(df).collect()
    assert len(steps) == 1 and (steps[0]["loss"], steps[0]["train_loss"]) == (0.5992, None)


def test_streaming_matches_batch(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1)
    rows = [(t + datetime.timedelta(minutes=7 * i), i % 3, float(i), "error" if i % 10 == 0 else "view") for i in range(200)]
    spark.createDataFrame(rows, "ts timestamp, user int, value double, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    want = {r["window_start"]: r for r in telemetry.windowed(batch, "ts", "value", "event_type = 'error'").collect()}
    run = telemetry.windowed(stream, "ts", "value", "event_type = 'error'").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    run.processAllAvailable()
    run.stop()
    found = {r["window_start"]: r for r in spark.table("windows").collect()}
    assert found.keys() == want.keys() and all(found[k]["total_requests"] == want[k]["total_requests"] and found[k]["latency_p50"] == want[k]["latency_p50"] for k in want)
    assert telemetry.sessions(batch, "ts", "user", "10 minutes").count() == 200


def test_warm_up_and_preview(spark):
    df = spark.createDataFrame([(True, None), (True, "x"), (False, None), (None, None)], "w boolean, error string")
    warm, rest = latency.warm_up(df, F.col("w"), F.col("error").isNull())
    assert tuple(warm.collect()[0]) == (2, 1) and rest.count() == 2
    assert [r[0] for r in spark.createDataFrame([("abc😀d",), (None,)], "t string").select(prompts.preview(F.col("t"), 4)).collect()] == ["abc😀", None]
