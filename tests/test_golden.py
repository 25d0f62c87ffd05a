"""Rows worked out by hand from what the records are to mean, not from the library's constants."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import choice, latex, numbers
from tallyforge.functions.text import strip
from tallyforge.operators import accuracy, compare, examples, latency, leakage, lineage, prompts, routing
from tallyforge.sources import readers, writers


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_strip_takes_white_space_of_any_kind(spark):
    assert column(spark, ["A\n", "\t A", "\u00a0A\u3000", "\x1cA\x85", "a b", "", None, " \n"], strip) == ["A", "A", "A", "A", "a b", "", None, ""]


def test_numbers_with_white_space(spark):
    values = ["1\n2", "1 2", " 1,200\n", "50%", "50 %\n", "\t5", "5\t%", "1__2", "1_2", "1d", "0x1p3", "", None, "%"]
    assert column(spark, values, numbers.parse_number) == [None, 12.0, 1200.0, 0.5, 0.5, 5.0, 0.05, None, 12.0, None, None, None, None, None]


def test_letters_of_the_first_explicit_form(spark):
    values = ["The answer is B", "answer is A. No, answer is C", "I choose a dog", "answer is definitely B", "answer depends", "E", "", "so\n(b) it is", "c\nd", "Answer is: (d)"]
    assert column(spark, values, choice.first_choice) == ["B", "A", "A", "D", None, None, None, "B", "C", "D"]


@pytest.mark.parametrize("a, b, same", [("sqrt(x**2)", "x", False), ("x", "x", True), ("2(x+1)", "2x+2", True), ("x**2", "(-x)**2", True), ("(x-1)(x+1)", "x**2-1", True), ("abs", "x", False), ("1" + "+1" * 400, "401", True)])
def test_expressions_at_negative_points_too(a, b, same):
    assert latex.same_value(a, b) is same


def test_mixed_examples_keep_the_prompt_and_strip_the_answer(spark):
    raw = spark.createDataFrame([("  Which?\n", "b\n", "s"), ("Say", " it is so\t", "s"), (" ", "x", "s"), ("", "A", "s"), (None, "A", "s")], "prompt string, answer string, source string")
    found = [tuple(r) for r in examples.mixed_examples(raw).collect()]
    assert found == [("  Which?\n", "B", "multiple_choice", "s"), ("Say", "it is so", "free_text", "s"), (" ", "x", "free_text", "s")]


def test_boxed_references(spark):
    raw = spark.createDataFrame([("p", "\\boxed{}\n", "1", "t"), ("p", " so 5\n", "1", "t"), ("p", "\\boxed{5}", "1", "t")], "problem string, solution string, level string, type string")
    assert [(r["reference_answer"], r["reference_is_boxed"]) for r in examples.boxed_examples(raw).collect()] == [("\\boxed{}", True), ("so 5", False), ("5", True)]


def test_reasons_of_unscorable_rows(spark):
    df = spark.createDataFrame([("\\boxed{1}", "1", None, True), ("\\boxed{1}", "1", None, False), ("x", "1", None, False), ("\\boxed{1}", "1", "late", False), ("\\boxed{1}", "1", "", True)], "response string, ref string, error string, boxed boolean")
    found = [(r["ambiguity_reason"], r["correct"]) for r in accuracy.score_boxed(df, "response", "ref", "error", F.col("boxed")).collect()]
    assert found == [(None, True), ("reference_not_boxed", False), ("no_boxed_answer_in_response", False), ("request_error: late", False), (None, True)]


def test_breakdowns_come_by_name(spark):
    df = spark.createDataFrame([("b", True, True), ("a", False, True), ("", True, False), (None, False, True), (" ", True, True)], "category string, correct boolean, scorable boolean")
    assert [(r["category"], r["correct"], r["total"]) for r in accuracy.by_category(df).collect()] == [(" ", 1, 1), ("a", 0, 1), ("arc-challenge", 1, 2), ("b", 1, 1)]
    assert [r["category"] for r in accuracy.by_source(df, "category").collect()] == [None, "", " ", "a", "b"]


def test_ids_are_gapless_in_any_partitioning(spark):
    n = 1_000_000
    base = spark.range(n).select((F.col("id") * 7919 % n).alias("k"))
    firsts = []
    for df, adaptive in ((base, "true"), (base.repartition(37), "true"), (base.repartition(11), "false")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "64")
        try:
            out = prompts.number_ids(df, "p", "k").withColumn("rank", F.substring_index("id", "-", -1).cast("bigint"))
            row = out.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_if(F.col("rank") != F.col("k"))).collect()[0]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        firsts.append(tuple(row))
    assert firsts == [(n, n, 0, n - 1, 0)] * 3
    assert prompts.number_ids(base.limit(0), "p", "k").collect() == []
    requests = spark.range(1000).withColumnRenamed("id", "nr")
    ranked = prompts.number_ids(spark.range(30).withColumnRenamed("id", "k"), "p", "k").withColumn("rank", F.substring_index("id", "-", -1).cast("bigint"))
    assert prompts.assign_cyclic(requests, "nr", ranked, "rank", 30).count() == 1000


def test_leakage_of_other_alphabets(spark):
    df = spark.createDataFrame([(1, "Привет, мир!"), (2, "привет мир"), (3, "El niño comió."), (4, "el nino comio"), (5, "你好，世界"), (6, "?!"), (7, None)], "id int, t string")
    assert sorted(r["id"] for r in leakage.exact(df.where("id IN (2, 4, 5, 6, 7)"), "t", df.where("id IN (1, 3)"), "t").collect()) == [2]
    assert sorted(r["id"] for r in leakage.exact(df, "t", df.where("id IN (5, 6, 7)"), "t").collect()) == [5]


def test_leakage_by_ngrams_against_brute_force(spark):
    """Boilerplate that all items share, and copies of single items; the candidates by rare n-grams lose none."""
    shared = "read the following task with care and then write the final number after the mark "
    items = [(i, shared + " ".join(f"w{i}x{k}" for k in range(12)) if i % 2 else shared) for i in range(20)]
    docs = [(100 + i, f"in front of it {items[i][1]} and behind it") for i in range(20)] + [(200, shared), (201, " ".join(f"w3x{k}" for k in range(12))), (202, None), (203, "")]
    train, held = spark.createDataFrame(docs, "doc int, t string"), spark.createDataFrame(items, "item int, q string")
    found = {(r["doc"], r["item"], r["shared"]) for r in leakage.containment(train, "doc", "t", held, "item", "q", n=8, least=0.5).collect()}

    def grams(t):
        w = (t or "").split()
        return {tuple(w[k : k + 8]) for k in range(len(w) - 7)}

    want = {(d, i, len(grams(t) & grams(q))) for d, t in docs for i, q in items if grams(q) and len(grams(t) & grams(q)) >= 0.5 * len(grams(q))}
    assert found == want and want
    assert {(r["doc"], r["item"], r["shared"]) for r in leakage.containment(train, "doc", "t", held, "item", "q", n=8, least=0.5, broadcast_most=0).collect()} == want


def test_several_baselines_are_an_error(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 4.0), ("a", 3.0)], "role string, m double")
    with pytest.raises(Exception, match="several rows"):
        compare.against(df, "role", "a", [], "m").collect()
    assert sorted(r["ratio"] for r in compare.against(df, "role", "b", [], "m").collect()) == [0.5, 0.75, 1.0]
    assert [r["ratio"] for r in compare.against(df, "role", "z", [], "m").collect()] == [None] * 3


def test_responses_join_their_examples(spark):
    items = spark.createDataFrame([("g", 0, "5"), ("g", 1, "6"), ("g", 2, "7"), (None, 3, "8")], "benchmark string, index int, reference_answer string")
    said = spark.createDataFrame([("g", 0, "#### 5", 1.0, None), ("g", 1, None, 2.0, "late"), ("h", 2, "#### 7", 1.0, None), ("g", 0, "#### 6", 1.0, None), (None, 3, "#### 8", 1.0, None)], "benchmark string, index int, text string, latency_ms double, error string")
    found = accuracy.score_numeric(examples.with_responses(items, said), "text", "reference_answer", "error")
    assert sorted((r["index"], r["error"] or "", r["scorable"], r["correct"]) for r in found.collect()) == [(0, "", True, False), (0, "", True, True), (1, "late", False, False), (2, "no response", False, False), (3, "no response", False, False)]


def test_requests_without_a_student_go_to_the_teacher(spark):
    teacher, student = spark.createDataFrame([(1, 10.0, None), (2, 20.0, None)], "n int, latency_ms double, error string"), spark.createDataFrame([(1, 3.0, None)], "n int, latency_ms double, error string")
    for policy in ("cascading", "always_teacher"):
        rows = routing.route(routing.paired(teacher, student, ["n"]), policy).orderBy("n").collect()
        assert rows[1]["selected_model"] == "teacher" and rows[1]["routed_latency_ms"] == 20.0


def test_approximate_percentiles(spark):
    df = spark.range(10_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    for r in latency.summarize(df, ["g"], "v", F.lit(True), accuracy=1000).collect():
        assert abs(r["latency_p50"] - 5000) <= 12 and abs(r["latency_p99"] - 9900) <= 12


def test_extra_prompts(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"prompt": "a"}\n\n\t\n{"other": 1}\n {"prompt": "b"} \n', encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text("no json\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_extra_prompts(spark, f"file://{tmp_path}/good.jsonl").collect()] == [("extra-0", "extra", "a"), ("extra-3", "extra", ""), ("extra-4", "extra", "b")]
    assert readers.read_extra_prompts(spark, f"file://{tmp_path}/none.jsonl").collect() == [] and readers.read_extra_prompts(spark, None).collect() == []
    with pytest.raises(Exception):
        readers.read_extra_prompts(spark, f"file://{tmp_path}/bad.jsonl").collect()


def test_lenient_prompts(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt": "a"}\n\t\n plain text\u00a0\n{"x": 1}\n', encoding="utf-8")
    assert [r[0] for r in readers.read_prompts_lenient(spark, f"file://{tmp_path}/p.jsonl").collect()] == ["a", "plain text", '{"x": 1}']


def test_results_come_in_the_order_of_their_index(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("index"), (F.col("id") % 2 == 0).alias("scorable")).repartition(7)
    writers.write_scored(df, f"file://{tmp_path}/all", f"file://{tmp_path}/side", "index")
    lines = [json.loads(line)["index"] for path in sorted((tmp_path / "all").glob("part-*")) for line in path.read_text().splitlines()]
    assert lines == list(range(1000)) and len(list((tmp_path / "side").glob("part-*"))) > 0


def test_metadata_are_captured(spark):
    row = lineage.capture(spark, {"a": 1}, 7).collect()[0]
    assert row["seed"] == 7 and any(x.lower().startswith("pyspark==") for x in row["pip_freeze"]) and row["gpu_count"] == len(row["gpus"]) and row["spark_version"] == spark.version
    assert lineage._said("no-such-command") == []


def test_release_removes_what_was_made(spark):
    from tallyforge import session

    kept = list(session._made)
    session._made.clear()
    path = session.materialize(spark.range(3).toDF("k"), "gone").inputFiles()[0]
    session.release(spark)
    assert not readers.exists(spark, path)
    session._made.extend(kept)
