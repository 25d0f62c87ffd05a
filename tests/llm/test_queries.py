import pytest

pytest.importorskip("tallyforge.llm")
from tallyforge.llm import queries


def test_truncation_of_pairs_is_that_of_all_texts(spark, tmp_path):
    """A closing formula and a full copy that only ``gsm8k_unscorable`` has count for ``teacher_outputs`` too."""
    full = "First we write down the known amounts. After that the workshop finishes 40 tiles a day. Over 6 days that comes to 240 tiles in all. It fits."
    stored = [(1, "It was worked out for item 900 as shown.\n#### see above"), (2, full), (3, full[:-4])]
    teacher = [(i, "r", "Question: How many tiles?", text) for i, text in stored]
    graded = [(100 + i, "r", "How many?", f"It was worked out for item {i} as shown.\n#### see above") for i in range(8)]
    spark.createDataFrame(teacher, "row_id bigint, run_id string, prompt string, teacher_completion string").write.parquet(f"{tmp_path}/teacher_outputs.parquet")
    spark.createDataFrame(graded, "row_id bigint, run_id string, question string, model_response string").write.parquet(f"{tmp_path}/gsm8k_unscorable.parquet")
    in_pairs = {r["row_id"] for r in queries.p3_found(spark, str(tmp_path)).where("defect = 'truncated'").collect()}
    assert in_pairs == {r["row_id"] for r in queries.p2_found(spark, str(tmp_path)).where("table_name = 'teacher_outputs'").collect()}
    assert 1 not in in_pairs
