"""Spark session defaults shared by tests, bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Input bytes per shuffle partition to aim for. Far less of them is shuffled, as lines are combined before.
PARTITION_BYTES = 1024**3
# Map outputs are tracked per map and partition, so their number must stay bounded; beyond it partitions grow and spill.
MOST_PARTITIONS = 20_000


def partitions_for(input_bytes: int, at_least: int = 200) -> int:
    """Shuffle partitions for an input size; adaptive execution merges those that turn out small."""
    return min(MOST_PARTITIONS, max(at_least, -(-input_bytes // PARTITION_BYTES)))


def build_session(
    app_name: str = "tillwright", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Create (or reuse) a session; ``conf`` keys use ``__`` for dots and override the defaults.

    ``input_bytes`` (the size of the transactions to be read) sets the number of shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions_for(input_bytes)))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
