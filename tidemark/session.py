"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot partition even where that costs one more shuffle above the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows that lie by one of a join's keys stay there: diagnoses by admission are not dealt again by admission and entity
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on to the caller's session; cluster sizing is left alone."""
    for key, setting in _SETTINGS.items():
        spark.conf.set(key, setting)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


_scopes: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; inside :func:`staging` it is one that goes with the block."""
    base = _scopes[-1] if _scopes else shared_dir(spark)
    return f"{base}/tidemark-{uuid.uuid4().hex}/{name}"


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Delete what is staged in the block when it ends. Frames made inside must be written by then.

    One plan at a time: the scope belongs to the process, not to a thread.
    """
    scope = f"{shared_dir(spark)}/tidemark-run-{uuid.uuid4().hex}"
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        path = spark._jvm.org.apache.hadoop.fs.Path(scope)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage in a way that survives lost executors, gives the optimiser true
    sizes, and makes the rows the same for every later reader.
    """
    spark = df.sparkSession
    target = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def side_by_side(calls: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """Results of calls that each write intermediates of their own: their jobs share the cluster instead of queueing.

    For a fixed, small number of independent branches of a plan.
    """
    with ThreadPoolExecutor(len(calls)) as pool:
        return [done.result() for done in [pool.submit(call) for call in calls]]


def table_path(base: str, table: str) -> str:
    return os.path.join(base, f"{table}.parquet")
