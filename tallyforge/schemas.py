"""Schemas of the records, as DDL, which readers and ``createDataFrame`` take as it is."""

from __future__ import annotations

PROMPT = "id STRING, benchmark STRING, prompt STRING"
TEACHER_OUTPUT = (
    "id STRING, benchmark STRING, prompt STRING, teacher_completion STRING, teacher_model STRING, generation_parameters STRUCT<temperature: DOUBLE, top_p: DOUBLE, max_tokens: INT>,"
    " latency_ms DOUBLE, finish_reason STRING, error STRING"
)
RUN_META = (
    "timestamp_utc STRING, hostname STRING, seed BIGINT, git_commit STRING, config_hash STRING, slurm_job_id STRING, gpu_count INT,"
    " gpus ARRAY<STRUCT<index: INT, name: STRING, total_memory_mb: BIGINT>>, pip_freeze ARRAY<STRING>,"
    " python_version STRING, platform STRING, spark_version STRING"
)
