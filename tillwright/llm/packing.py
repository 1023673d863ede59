"""Packing of documents into sequences by shortest-pack-first over the length histogram (Krell et al., 2021).

Documents are encoded where they lie and cut into pieces of at most one sequence. Only the histogram of piece lengths
(at most one row per length) reaches the driver, which places lengths longest first and keeps counts of equal packing
patterns instead of single packs. Pieces then find their sequence by their rank among pieces of equal length.

Null texts are empty documents (the end id only); null and repeated ids are kept. An empty table gives no rows.
Other columns of the input are ignored.

Very long texts are cut into pieces of a whole sequence. Pieces of equal length take their places by task and by their order
in it, so ties depend on how the rows are dealt out; every placing has the same number of sequences.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import crc32, in_chunks, stage_compressed, texts_of, whole_text
from tillwright.llm.piece_tokens import byte_encoder

SEQUENCE_TOKENS = 2048
END_ID = 1

PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, part_rank bigint"
)
_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("part", pa.int32()), ("part_rank", pa.int64()),
])
_PLACED = pa.schema([*list(_PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint"
)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns as (how many packs, ((length, times), ...)) with the slots in order of placement.

    Lengths go longest first. A piece goes to the shortest pack with room, else to a new pack, which then is the
    shortest for pieces of the same length. Whole groups of equal packs move at once; a group is split only when the
    pieces of a length run out, so the number of patterns stays within a few times the number of lengths.
    """
    by_fill: dict[int, list[list]] = defaultdict(list)
    fills: list[int] = []

    def put(fill: int, count: int, slots: tuple) -> None:
        if count:
            if not by_fill[fill]:
                heapq.heappush(fills, fill)
            by_fill[fill].append([count, slots])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if fills and fills[0] + length <= capacity:
                fill = fills[0]
                count, slots = by_fill[fill][-1]
                room = (capacity - fill) // length
                # As long as only this group is the shortest it takes further pieces of this length in turn.
                if len(by_fill[fill]) > 1:
                    room = 1
                elif len(fills) > 1:
                    room = min(room, max(1, -(-(min(fills[1:3]) - fill) // length)))
                moved, times = (count, min(room, left // count)) if left >= count else (left, 1)
                by_fill[fill].pop()
                if not by_fill[fill]:
                    heapq.heappop(fills)
                put(fill, count - moved, slots)
                put(fill + length * times, moved, _with(slots, length, times))
                left -= moved * times
            else:
                each = capacity // length
                put(each * length, left // each, ((length, each),))
                put(left % each * length, 1 if left % each else 0, ((length, left % each),))
                left = 0
    return [(count, slots) for fill in sorted(by_fill, reverse=True) for count, slots in by_fill[fill]]


def _with(slots: tuple, length: int, times: int) -> tuple:
    if slots[-1][0] == length:
        return (*slots[:-1], (length, slots[-1][1] + times))
    return (*slots, (length, times))


def slots_by_length(patterns: list[tuple[int, tuple]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For every length its runs of ranks: (first rank, packs in the run, first sequence, offset), ascending.

    A run says: the pieces of this length with these ranks go, one each, to consecutive sequences at this offset.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, slots in patterns:
        offset = 0
        for length, times in slots:
            # ``times`` neighbouring slots of one pattern: rank runs over packs first, then over the slots.
            runs[length].append((next_rank[length], count, sequence, offset))
            next_rank[length] += count * times
            offset += length * times
        sequence += count
    return {length: tuple(np.array(column) for column in zip(*rows, strict=True)) for length, rows in runs.items()}


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Encode every document and cut it into pieces, numbered per task and length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    ids = memoryview(tokens.encode(text) + end)
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        checksum = crc32(ids[4 * start : 4 * (start + length)])
                        yield doc_id, start, length, checksum, total, part, seen[length]
                        seen[length] += 1

        yield from in_chunks(rows(), _PIECE)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return chosen.mapInArrow(encode, PIECE_SCHEMA)


def pack(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: its document, place in it and checksum, and its sequence and offset there."""
    pieces = stage_compressed(cut_documents(docs, vocabulary, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row per task and length: the ranks of a length continue from task to task.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most ``capacity`` rows, whatever the size of the corpus.
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = slots_by_length(pack_histogram(histogram, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for value, rows in zip(values, np.split(order, starts[1:]), strict=True):
                first, packs, base, at = shared.value[int(value)]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                slot, pack_number = np.divmod(rank[rows] - first[run], packs[run])
                sequence[rows] = base[run] + pack_number
                offset[rows] = at[run] + slot * value
            columns = [batch.column(name) for name in _PLACED.names[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema=_PLACED)

    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("part_rank") + F.col("before"))
    return ranked.select(*PLACED_SCHEMA.replace(" bigint", "").split(", ")[:5], "rank").mapInArrow(place, PLACED_SCHEMA)
