"""Benchmark decontamination by greedy string tiling (Wise, 1996).

Documents and benchmark items are sequences of words (letters and digits of any script, case folded). Hashed windows
of ``MIN_MATCH`` words, rolled Karp-Rabin style over the word numbers, find the seeds that a document shares with an
item. The seeds on one diagonal form matches, verified by construction as equal windows of word numbers; the longest
match free of marked words is marked again and again, what a mark cuts off stays a candidate, until none of at least
``MIN_MATCH`` words is left. The marked share of the item's words is its coverage. Tiles may stand in any order in the
document, so reordered passages are caught like moved ones.

The benchmark goes to the tasks in blocks of a bounded number of words; every document meets every block. Items shorter than
``MIN_MATCH`` words match as a whole. Null and wordless items and texts match nothing. Null ids and repeated rows are
kept. Empty tables give no rows. Other columns are ignored (``drop_contaminated`` returns those of the documents).

Among matches of equal length the first in the document, then in the item, is tiled first.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tillwright.llm.common import in_chunks, stage_compressed, texts_of, whole_text
from tillwright.plans.ordered import running_total

MIN_MATCH = 5
COVERAGE = 0.8
# Words of benchmark text that go to the tasks at once: about 100 MB with all their windows.
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"\w+")

PAIR_SCHEMA = "doc_id bigint, item_id bigint, tiles bigint, matched_words bigint, item_words bigint, coverage double"
_PAIR = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int64()), ("matched_words", pa.int64()),
    ("item_words", pa.int64()), ("coverage", pa.float64()),
])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def windows(numbers: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin value of every window of ``width`` numbers, modulo 2**64."""
    total = np.zeros(max(0, len(numbers) - width + 1), np.uint64)
    for at in range(width):
        total = total * _BASE + numbers[at : at + len(total)].astype(np.uint64)
    return total


def greedy_tiles(doc: np.ndarray, item: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], width: int) -> list[tuple]:
    """Tiles (document start, item start, length), longest first; ``seeds`` are starts of equal windows."""
    at_doc, at_item = seeds
    order = np.lexsort((at_doc, at_doc - at_item))
    at_doc, at_item = at_doc[order], at_item[order]
    breaks = np.flatnonzero((np.diff(at_doc) != 1) | (np.diff(at_item) != 1)) + 1
    heap = []
    for start, end in zip([0, *breaks], [*breaks, len(at_doc)], strict=True):
        heap.append((-(int(end - start) + width - 1), int(at_doc[start]), int(at_item[start])))
    heapq.heapify(heap)
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles = []
    while heap:
        length, d, i = heapq.heappop(heap)
        length = -length
        free = free_doc[d : d + length] & free_item[i : i + length]
        if free.all():
            free_doc[d : d + length] = free_item[i : i + length] = False
            tiles.append((d, i, length))
            continue
        # What earlier marks left of this match competes again.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start >= width:
                heapq.heappush(heap, (-(end - start), d + start, i + start))
    return tiles


class Benchmark:
    """The windows of a block of items, by width, sorted for lookup."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int = MIN_MATCH):
        self.numbers: dict[str, int] = {}
        self.items = []
        by_width: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if words:
                own = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
                by_width[min(min_match, len(own))].append((windows(own, min(min_match, len(own))), len(self.items)))
                self.items.append((item_id, own))
        self.seeds = {}
        for width, parts in by_width.items():
            values = np.concatenate([v for v, _ in parts])
            item = np.concatenate([np.full(len(v), at, np.int64) for v, at in parts])
            start = np.concatenate([np.arange(len(v)) for v, _ in parts])
            order = np.argsort(values, kind="stable")
            self.seeds[width] = values[order], item[order], start[order]

    def shared_seeds(self, doc: np.ndarray, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per item: starts in the document and in the item of windows with equal words."""
        values, item, start = self.seeds[width]
        own = windows(doc, width)
        low = np.searchsorted(values, own)
        hit = np.flatnonzero(values[np.minimum(low, len(values) - 1)] == own)
        if not len(hit):
            return {}
        low, high = low[hit], np.searchsorted(values, own[hit], side="right")
        many = high - low
        at_doc = np.repeat(hit, many)
        found = np.repeat(low, many) + np.arange(len(at_doc)) - np.repeat(np.cumsum(many) - many, many)
        at_item, which = start[found], item[found]
        order = np.argsort(which, kind="stable")
        at_doc, at_item, which = at_doc[order], at_item[order], which[order]
        cuts = np.flatnonzero(np.diff(which)) + 1
        pieces = zip(np.split(at_doc, cuts), np.split(at_item, cuts), strict=True)
        return dict(zip(which[np.concatenate([[0], cuts])].tolist(), pieces, strict=True))

    def coverage(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """(item_id, tiles, matched words, item words) of every item that shares a seed with the text."""
        get = self.numbers.get
        doc = np.array([get(word, 0) for word in words_of(text)], np.int64)
        for width in self.seeds:
            if len(doc) < width:
                continue
            for at, (at_doc, at_item) in self.shared_seeds(doc, width).items():
                item_id, item = self.items[at]
                # Equal hashes are checked word by word, so a chance collision is no seed.
                same = np.ones(len(at_doc), bool)
                for k in range(width):
                    same &= doc[at_doc + k] == item[at_item + k]
                if same.any():
                    tiles = greedy_tiles(doc, item, (at_doc[same], at_item[same]), width)
                    yield item_id, len(tiles), sum(t[2] for t in tiles), len(item)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; only one block is on the driver at a time."""
    items = stage_compressed(
        benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().alias("text"))
        .withColumn("n", F.size(F.split("text", r"\s+"))),
        "benchmark",
    )
    numbered = running_total(items, [F.col("item_id").asc_nulls_first(), F.col("text")], "until", F.col("n"))
    blocked = stage_compressed(numbered.withColumn("block", F.floor(F.col("until") / block_words)), "blocks")
    last = blocked.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        rows = blocked.filter(F.col("block") == block).select("item_id", "text").collect()
        if rows:
            yield [tuple(row) for row in rows]


def tile_coverage(docs: DataFrame, items: list[tuple], min_match: int = MIN_MATCH) -> DataFrame:
    """Pairs of a document and an item that share a seed, with the coverage of the item."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(shared.value, min_match)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    for item_id, tiles, matched, total in benchmark.coverage(text):
                        yield doc_id, item_id, tiles, matched, total, matched / total

        yield from in_chunks(rows(), _PAIR)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return chosen.mapInArrow(match, PAIR_SCHEMA)


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every (document, item) in which tiles cover at least ``coverage`` of the item's words."""
    found = None
    for items in benchmark_blocks(benchmark, block_words):
        pairs = tile_coverage(docs, items, min_match).filter(F.col("coverage") >= coverage)
        found = pairs if found is None else found.unionByName(pairs)
    return docs.sparkSession.createDataFrame([], PAIR_SCHEMA) if found is None else found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text covers no item. Rows are judged where they lie."""
    for items in benchmark_blocks(benchmark, block_words):
        docs = docs.filter(_is_clean(docs.sparkSession.sparkContext.broadcast(items), min_match, coverage)(whole_text()))
    return docs


def _is_clean(items: Broadcast, min_match: int, coverage: float) -> Callable[[Column], Column]:
    """Whether a text covers no item of a block."""

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = Benchmark(items.value, min_match)
        for texts in batches:
            clean = [all(matched / total < coverage for _, _, matched, total in block.coverage(t)) for t in texts]
            yield pd.Series(clean, dtype=bool)

    return F.pandas_udf(judge, BooleanType())
