"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    name: str = "sightline", master: str | None = None, initial_partitions: int = 20_000, **settings
) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave ``master`` unset.

    Shuffles of a cluster start with ``initial_partitions``, which adaptive execution merges: it
    merges small partitions of an aggregation but does not split large ones.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python call site of every expression slows wide plans down.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", "8")
        )
    else:
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial_partitions)
        )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="sightline-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
