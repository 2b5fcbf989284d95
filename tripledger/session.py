"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import SparkSession


SHUFFLE_PARTITION_BYTES = 128 << 20


def shuffle_width(shuffled_bytes: int) -> int:
    """Partitions that keep a shuffle of this size at about 128 MB each."""
    return max(200, math.ceil(shuffled_bytes / SHUFFLE_PARTITION_BYTES))


def build_session(
    app: str = "tripledger", shuffled_bytes: int | None = None, **conf: str,
) -> SparkSession:
    """A session with the settings the operators assume.

    Adaptive execution merges small shuffle partitions but never adds any, so a
    large job has to start wide enough. ``shuffled_bytes`` is the largest shuffle to
    expect: for cleaning, the size of the clean rows; for metrics, far less.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffled_bytes:
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
            str(shuffle_width(shuffled_bytes)))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a fresh temporary folder,
    which is then recorded so that later calls agree. On a cluster, where such a folder would
    differ from machine to machine, the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tripledger-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")
