"""Session settings and durable scratch space."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "daygauge", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A folder of our own is set only where the session names none, which is the local test case.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if configured is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="daygauge-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage, so that a lost executor cannot change it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def landed(df: DataFrame) -> DataFrame:
    """As lasting as ``durable``, for rows that several steps read: written as Parquet, of which a step reads only its columns."""
    path = scratch_path(df.sparkSession, "landed")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(steps: Sequence[Callable[[], object]]) -> list:
    """Results of steps that do not need each other. Their jobs go to Spark from a thread each, so that no core waits for one step's
    small jobs or last tasks."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return list(pool.map(lambda step: step(), steps))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they start (a local worker sees no path the driver added)."""
    context = spark.sparkContext
    if getattr(context, "_daygauge_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="daygauge-"), "daygauge"), "zip",
                                  os.path.dirname(home), os.path.basename(home))
    context.addPyFile(archive)
    context._daygauge_shipped = True
