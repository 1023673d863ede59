"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.plans.staging import hadoop_path, shared_path


# Rows per Arrow batch: documents average some kilobytes and a few are very long, and a batch is held several times.
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """Once per application: send this package's source to the Python workers, as ``--py-files`` would, and keep
    batches of texts small unless the session already asks for smaller ones."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}-source.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader so that the folder may be in any store."""
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def stage_compressed(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared checkpoint folder with zstd and return a scan: a cut in the lineage that survives
    lost executors and costs less of the shared disk than the default codec."""
    return stage_compressed_at(df, label)[0]


def stage_compressed_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``stage_compressed`` and the path, for tables that are dropped with ``unstage``."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def unstage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    target, files = hadoop_path(spark, path)
    files.delete(target, True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, empty where null."""
    return [value or "" for value in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def crc32(data: bytes | memoryview) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def in_chunks(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Group row tuples into record batches of bounded length."""
    pending: list[tuple] = []
    for row in rows:
        pending.append(row)
        if len(pending) >= size:
            yield as_batch(pending, schema)
            pending = []
    if pending:
        yield as_batch(pending, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(values), field.type) for values, field in zip(columns, schema, strict=True)], schema=schema
    )
