"""Token ids of a corpus as wavelet-matrix shards in parquet files.

``write_shards`` range-partitions documents by id, encodes them in ascending order and writes shards of about
``SHARD_TOKENS`` ids; each task writes one file, committed by Spark, so that a lost executor leaves no half file.
A shard row holds the packed bit-planes with their rank blocks, and the ids and starts of its documents. From the same
file ``read_tokens`` decodes shards, ``token_counts`` and ``occurrences`` answer without decoding.

Null texts are empty documents (the end id only). Null ids come first. Rows with equal ids are kept, ordered by text.
An empty table gives no shards. Other columns of the input are ignored.

A text longer than a shard makes a larger shard; texts of any length are encoded in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwright.llm.common import crc32, in_chunks, texts_of, whole_text
from tillwright.llm.piece_tokens import word_encoder
from tillwright.llm.wavelet import Plane, WaveletMatrix, build

END_ID = 1
# Ids per shard: the planes of one are about 2 MB. Only a longer document makes a larger shard.
SHARD_TOKENS = 1 << 20

SHARD_SCHEMA = (
    "part int, part_start bigint, n_tokens bigint, doc_ids array<bigint>, doc_starts array<bigint>, "
    "planes array<struct<zeros: bigint, bits: binary, ranks: binary>>"
)
_PLANE = pa.struct([("zeros", pa.int64()), ("bits", pa.binary()), ("ranks", pa.binary())])
_SHARD = pa.schema([
    ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_starts", pa.list_(pa.int64())), ("planes", pa.list_(_PLANE)),
])


def _shard(part: int, part_start: int, doc_ids: list, starts: list[int], ids: bytes) -> pa.RecordBatch:
    sequence = np.frombuffer(ids, "<u4")
    planes = [{"zeros": p.zeros, "bits": p.bits, "ranks": p.ranks} for p in build(sequence)]
    values = [[part], [part_start], [len(sequence)], [doc_ids], [starts], [planes]]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, f.type) for v, f in zip(values, _SHARD, strict=True)], schema=_SHARD
    )


def write_shards(docs: DataFrame, path: str, vocabulary: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``doc_id, text`` and write the shards in ascending document order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        written, size, doc_ids, starts, held = 0, 0, [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids = tokens.encode(text) + end
                doc_ids.append(doc_id)
                starts.append(size)
                held.append(ids)
                size += len(ids) // 4
                if size >= shard_tokens:
                    yield _shard(part, written, doc_ids, starts, b"".join(held))
                    written, size, doc_ids, starts, held = written + size, 0, [], [], []
        if doc_ids:
            yield _shard(part, written, doc_ids, starts, b"".join(held))

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    # The codec of the file squeezes the upper planes, which are almost constant.
    ordered.mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def with_part_offsets(shards: DataFrame, rows: DataFrame, local: Column) -> DataFrame:
    """Add ``start``: ``local`` (a position within the part) plus the ids of all parts before.

    The offsets are one row per task that wrote shards, which bounds their broadcast.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        shards.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
        .select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    )
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + local).drop("_before")


def _wavelet(row: dict) -> WaveletMatrix:
    return WaveletMatrix([Plane(**plane) for plane in row["planes"]], row["n_tokens"])


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def read_tokens(shards: DataFrame) -> DataFrame:
    """Decode every shard: part, doc_id, local_start (in the part), n_tokens and the checksum of its ids."""
    schema = pa.schema([
        ("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row in _shard_rows(batches):
                ids = memoryview(_wavelet(row).decode().astype("<u4").tobytes())
                starts = [*row["doc_starts"], row["n_tokens"]]
                for at, doc_id in enumerate(row["doc_ids"]):
                    start, end = starts[at], starts[at + 1]
                    yield row["part"], doc_id, row["part_start"] + start, end - start, crc32(ids[4 * start : 4 * end])

        yield from in_chunks(rows(), schema)

    return shards.mapInArrow(decode, "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """Occurrences of each given token over all shards, by rank on the planes."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row in _shard_rows(batches):
                matrix = _wavelet(row)
                yield from ((token, matrix.count(token)) for token in tokens)

        yield from in_chunks(rows(), schema)

    found = shards.select("n_tokens", "planes").mapInArrow(count, "token bigint, n bigint")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Every position of a token, by select on the planes: doc_id, position in the document, position in the part."""
    schema = pa.schema([
        ("part", pa.int32()), ("doc_id", pa.int64()), ("position", pa.int64()), ("part_position", pa.int64()),
    ])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row in _shard_rows(batches):
                starts = np.array(row["doc_starts"])
                for at in _wavelet(row).locate(token):
                    doc = int(np.searchsorted(starts, at, side="right")) - 1
                    yield row["part"], row["doc_ids"][doc], at - int(starts[doc]), row["part_start"] + at

        yield from in_chunks(rows(), schema)

    return shards.mapInArrow(locate, "part int, doc_id bigint, position bigint, part_position bigint")
