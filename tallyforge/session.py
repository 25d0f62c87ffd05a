"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the library expects of a session; a session that is already running keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tallyforge", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's defaults; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``, with columns pruned by what follows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (a local session, as in tests) is a temporary folder made, which
    goes away at exit. A session on a cluster without the setting is an error: a folder of one machine
    could not be read by the others.
    """
    global _own_dir
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None or not os.path.isdir(_own_dir):
        _own_dir = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that are removed by ``release``, or else when the driver ends."""
    path = f"{shared_dir(spark)}/tallyforge-{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(release, spark)
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove all files made so far. A driver that lives long calls it once the results that were built on them are written."""
    while _made:
        _remove(spark, _made.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so later stages start from files.

    Unlike a cached or locally checkpointed table the files outlive any executor; each is read with
    column pruning. They are removed by ``release``, or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
