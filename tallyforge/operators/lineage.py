"""Configuration and metadata of runs: driver-side helpers, and their tables."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import platform
import socket
import subprocess
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """A new dictionary: nested dictionaries merge, everything else is replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(path: str, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """A JSON, or if the parser is there YAML, file as a dictionary; empty is ``{}``, missing is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        held = yaml.safe_load(text)
    else:
        held = json.loads(text) if text.strip() else {}
    return deep_merge(held or {}, overrides or {})


def config_hash(config: dict[str, Any]) -> str:
    """Twelve hexadecimal digits over the configuration with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def text_hash(text: Column) -> Column:
    """The same for a column of serialised configurations."""
    return F.substring(F.sha2(text, 256), 1, 12)


def run_folder(root: str, kind: str, role: str, at: datetime.datetime | None = None) -> Path:
    """Make ``root/kind/kind-role-time`` with the time in UTC."""
    at = at or datetime.datetime.now(datetime.UTC)
    folder = Path(root) / kind / f"{kind}-{role}-{at.astimezone(datetime.UTC):%Y%m%dT%H%M%SZ}"
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def snapshot(config: dict[str, Any], folder: Path) -> Path:
    path = folder / "config.json"
    path.write_text(json.dumps(config, indent=2, sort_keys=True, default=str), encoding="utf-8")
    return path


def _said(*command: str) -> list[str]:
    """Lines that a command prints; none if it is not there or fails."""
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=30, check=True).stdout.strip().splitlines()
    except (OSError, subprocess.SubprocessError):
        return []


def gpus() -> list[dict[str, Any]]:
    """Index, name and memory of the driver's graphics processors, as their driver's tool lists them."""
    rows = [[x.strip() for x in line.split(",")] for line in _said("nvidia-smi", "--query-gpu=index,name,memory.total", "--format=csv,noheader,nounits")]
    return [{"index": int(r[0]), "name": r[1], "total_memory_mb": int(float(r[2]))} for r in rows if len(r) == 3]


def capture(spark: SparkSession, config: dict[str, Any], seed: int | None = None) -> DataFrame:
    """One row of metadata about this run, as its driver has it; what the machine does not tell is null."""
    held = gpus()
    row = {
        "timestamp_utc": datetime.datetime.now(datetime.UTC).isoformat(), "hostname": socket.gethostname(), "seed": seed, "git_commit": next(iter(_said("git", "rev-parse", "--short", "HEAD")), None),
        "config_hash": config_hash(config), "slurm_job_id": os.environ.get("SLURM_JOB_ID"), "gpu_count": len(held), "gpus": held,
        "pip_freeze": sorted(f"{d.metadata['Name']}=={d.version}" for d in metadata.distributions() if d.metadata["Name"]),
        "python_version": platform.python_version(), "platform": platform.platform(), "spark_version": spark.version,
    }
    return spark.createDataFrame([row], schemas.RUN_META)


def resolve_role(runs: DataFrame, models: DataFrame, role: str = "model_role") -> DataFrame:
    """Runs with the model that their role stands for; unknown roles keep a null."""
    return runs.join(models, role, "left")
