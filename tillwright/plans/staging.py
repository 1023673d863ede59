"""Staged tables in the cluster's shared checkpoint folder, and size-checked broadcasts.

A staged table cuts lineage and is read back with exact file statistics. It lives on shared
storage, so losing an executor never loses it, and several consumers of a small intermediate
result (flagged days, per-day measures) do not each recompute it from the transactions.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that may be broadcast. Rows here are a key and a few numbers (< 200 bytes),
# so this is at most about 40 MB per executor; larger sides take a shuffle join.
BROADCAST_ROWS = 200_000


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tillwright-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application so that it can be dropped afterwards."""
    return f"{shared_root(spark)}/tillwright/{spark.sparkContext.applicationId}/{label}-{uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(staged: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the (staged, cheap to count) table is within the bound."""
    return F.broadcast(staged) if staged.count() <= max_rows else staged


def bounded_side(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Stage ``df`` and broadcast it if its counted size allows, otherwise leave the join to the optimizer."""
    return broadcast_if_small(stage(df, label), max_rows)


def once(spark: SparkSession, key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` returns, built at the first call with ``key`` in this application and kept until drop_staged.

    Meant for staged tables that many queries read: they are written once, not once per query.
    """
    kept = _KEPT.setdefault(spark.sparkContext.applicationId, {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


_KEPT: dict[str, dict[tuple, Any]] = {}


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system (local, object store, HDFS), by the only handle PySpark has on them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables."""
    _KEPT.pop(spark.sparkContext.applicationId, None)
    target, files = hadoop_path(spark, f"{shared_root(spark)}/tillwright/{spark.sparkContext.applicationId}")
    files.delete(target, True)
