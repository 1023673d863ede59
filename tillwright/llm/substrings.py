"""Passages that stand more than once in a corpus, by compressed FM-indexes of shards and matching statistics.

A passage is a window of ``WINDOW`` consecutive words. Equal windows have to meet in one shard. For that each window
is led by one of its runs of ``GRAM`` words, the one with the least hash; consecutive windows with the same leader form
a block. Only blocks whose leader occurs again can hold a repeated window (others are left out without loss). Blocks
with equal content are counted and sent once; a shard takes all contents of its leaders, builds an FM-index of them
(``fm_index``), streams them through backward search, and reports the intervals whose matching statistics, over
occurrences counted twice or more, reach the window. The intervals go back to all texts that have the block.

Runs of words that a bounded sample finds in many texts are taken as leaders last. A window that reaches over the edge
of a common passage then has a leader of its own and falls out early, so the contents of one leader stay few however
many texts share the passage. The sample decides the work only, never the result.

Equal texts are handled once, counted twice. Words are runs of anything but ASCII white space, unchanged; null texts
have none. Windows are judged on the input. Texts shorter than a window keep all words. Repeated rows are copies of
each other, null ids are kept. Very long texts take memory in proportion to their words, one at a time. Ties between
leaders go to the leftmost. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import in_chunks, stage_compressed, whole_text
from tillwright.llm.fm_index import FmIndex
from tillwright.plans.staging import shared_path

WINDOW = 35
GRAM = 8
# Words of one shard to aim for.
SHARD_WORDS = 1 << 19
# Texts sampled for common runs of words, and how many of them must have a run for it to be common; most runs listed.
SAMPLE_TEXTS, COMMON_TEXTS, COMMON_GRAMS = 1_000, 4, 200_000
REMEMBERED_WORDS = 200_000

# A block in one number: 25 bits of a second hash of its text, 32 of its first word, 5 of its windows, 1 if its text repeats.
_TAG_BITS, _MOST_WINDOWS = 25, 32
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


class Blocks:
    """Cuts texts into blocks of windows with a common leader."""

    def __init__(self, common: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        if not 0 < gram <= window <= gram + _MOST_WINDOWS - 1:
            raise ValueError(f"a window must have {gram} to {gram + _MOST_WINDOWS - 1} words")
        self.common, self.window, self.gram = common, window, gram
        self.words: dict[bytes, int] = {}
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _hash(self, word: bytes) -> int:
        if (known := self.words.get(word)) is None:
            known = xxhash.xxh64_intdigest(word, 11)
            if len(self.words) < REMEMBERED_WORDS:
                self.words[word] = known
        return known

    def _sums(self, words: list[bytes]) -> np.ndarray:
        """Prefix sums of word hashes times powers of a factor: any run of words has a hash by two of them."""
        if len(self.powers) <= len(words):
            ones = np.ones(2 * len(words) + 1, np.uint64)
            factors = [np.where(np.arange(len(ones)) > 0, np.uint64(f), ones) for f in (_FACTOR, _INVERSE)]
            self.powers, self.inverses = (np.cumprod(f, dtype=np.uint64) for f in factors)
        own = np.fromiter(map(self._hash, words), np.uint64, len(words)) * self.powers[: len(words)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])

    def _runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))

    def grams(self, words: list[bytes]) -> np.ndarray:
        """Hashes of all runs of ``gram`` words."""
        at = np.arange(max(0, len(words) - self.gram + 1))
        return self._runs(self._sums(words), at, at + self.gram)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per block: hash of its leader, whether that is common, first word, number of windows, hash of its content."""
        if len(words) < self.window:
            return (*(np.zeros(0, t) for t in (np.uint64, bool, np.int64, np.int64, np.uint64)),)
        sums = self._sums(words)
        at = np.arange(len(words) - self.gram + 1)
        grams = self._runs(sums, at, at + self.gram)
        usual = np.zeros(len(grams), bool)
        if len(self.common):
            place = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
            usual = self.common[place] == grams
        order = (grams >> np.uint64(1)) | (usual.astype(np.uint64) << np.uint64(63))
        leader = np.lib.stride_tricks.sliding_window_view(order, self.window - self.gram + 1).argmin(axis=1)
        leader += np.arange(len(leader))
        start = np.flatnonzero(np.concatenate([[True], leader[1:] != leader[:-1]]))
        windows = np.diff(np.concatenate([start, [len(leader)]]))
        content = self._runs(sums, start, start + windows + self.window - 1)
        return grams[leader[start]], usual[leader[start]], start, windows, content


def text_key() -> Column:
    return F.xxhash64(whole_text())


def text_tag() -> Column:
    """A second hash, by which texts of one key are told apart."""
    return F.pmod(F.xxhash64(F.lit("tag"), whole_text()), F.lit(1 << _TAG_BITS))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, tag, copies and text of each text, staged in buckets by (key, tag): joins by them move the other side only."""
    spark = docs.sparkSession
    found = docs.select(text_key().alias("key"), text_tag().alias("tag"), whole_text().alias("text")).groupBy("key", "tag").agg(
        F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")
    )
    name, buckets = f"texts_{uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (found.write.option("compression", "zstd").option("path", shared_path(spark, "texts"))
     .bucketBy(buckets, "key", "tag").saveAsTable(name))
    return spark.table(name)


def _over_words(rows: DataFrame, text: str, kind: str, schema: pa.Schema, make: Callable, chunk: int = 20_000) -> DataFrame:
    """``make()`` in each task gives a function from (words, row without its text) to tuples of ``schema``."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()

        def found() -> Iterator[tuple]:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                names = [n for n in batch.schema.names if n != text]
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                others = batch.select(names).to_pylist()
                for own, row in zip(texts, others, strict=True):
                    yield from each((own or b"").split(), row)

        yield from in_chunks(found(), schema, chunk)

    return rows.mapInArrow(take, kind)


def common_grams(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Sorted hashes of runs of words that many of a bounded sample of the texts have."""
    every = max(1, texts.count() // SAMPLE_TEXTS)

    def make() -> Callable:
        blocks = Blocks(np.zeros(0, np.uint64), window, gram)
        return lambda words, row: ((int(g),) for g in np.unique(blocks.grams(words).view(np.int64)))

    sampled = texts.filter(F.pmod("key", F.lit(every)) == 0).select("text")
    runs = _over_words(sampled, "text", "gram bigint", pa.schema([("gram", pa.int64())]), make)
    often = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON_TEXTS)
    listed = often.orderBy(F.desc("n"), "gram").limit(COMMON_GRAMS).toArrow().column("gram")
    return np.sort(listed.to_numpy().astype(np.int64).view(np.uint64))


def repeated_blocks(texts: DataFrame, common: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(leader, content, key, place) of every block whose leader occurs more than once."""
    shared = texts.sparkSession.sparkContext.broadcast(common)
    names = ("leader", "usual", "content", "key", "place")
    schema = pa.schema([(n, pa.bool_() if n == "usual" else pa.int64()) for n in names])

    def make() -> Callable:
        blocks = Blocks(shared.value, window, gram)

        def each(words: list[bytes], row: dict) -> Iterator[tuple]:
            leader, usual, start, windows, content = blocks(words)
            place = row["tag"] << 38 | start << 6 | (windows - 1) << 1 | int(row["copies"] > 1)
            columns = (leader.view(np.int64).tolist(), usual.tolist(), content.view(np.int64).tolist(), [row["key"]] * len(start))
            return zip(*columns, place.tolist(), strict=True)

        return each

    kind = "leader bigint, usual boolean, content bigint, key bigint, place bigint"
    blocks = _over_words(texts.select("key", "tag", "copies", "text"), "text", kind, schema, make)
    # A leader that is no common run has few blocks, so they can be counted where they meet; common ones need no count
    # and are dealt out.
    spread = F.when(F.col("usual"), F.pmod(F.xxhash64("key", "place"), F.lit(1 << 20))).otherwise(-1).alias("spread")
    counted = blocks.select("*", spread).withColumn("n", F.sum(F.expr("1 + place % 2")).over(Window.partitionBy("leader", "spread")))
    return stage_compressed(counted.filter("usual or n > 1").select("leader", "content", "key", "place"), "blocks")


def _unpacked(place: str = "place") -> list[Column]:
    part = lambda shift, bits: F.shiftright(place, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return [part(38, _TAG_BITS).alias("tag"), part(6, 32).alias("start"), (part(1, 5) + 1).alias("windows")]


def block_contents(texts: DataFrame, blocks: DataFrame, window: int = WINDOW) -> DataFrame:
    """(shard, leader, content, weight, words) of every different block, from one of the texts that have it."""
    different = stage_compressed(
        blocks.groupBy("leader", "content").agg(
            F.sum(F.expr("1 + place % 2")).alias("weight"), F.first("key").alias("key"), F.first("place").alias("place")),
        "contents",
    )
    shards = max(1, math.ceil(different.count() * (window + window // 3) / SHARD_WORDS))
    wanted = (
        different.select("key", *_unpacked(), F.struct("leader", "content", "weight", *_unpacked()[1:]).alias("block"))
        .groupBy("key", "tag").agg(F.collect_list("block").alias("blocks"))
    )
    schema = pa.schema([("leader", pa.int64()), ("content", pa.int64()), ("weight", pa.int64()), ("words", pa.binary())])

    def make() -> Callable:
        def each(words: list[bytes], row: dict) -> Iterator[tuple]:
            for b in row["blocks"]:
                own = words[b["start"] : b["start"] + b["windows"] + window - 1]
                yield b["leader"], b["content"], b["weight"], b" ".join(own)

        return each

    joined = texts.select("key", "tag", "text").join(wanted.hint("shuffle_hash"), ["key", "tag"]).select("text", "blocks")
    kind = "leader bigint, content bigint, weight bigint, words binary"
    found = _over_words(joined, "text", kind, schema, make, 5_000)
    return found.withColumn("shard", F.pmod(F.xxhash64("leader"), F.lit(shards)).cast("int"))


def repeated_intervals(contents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(leader, content, begin, end): words of a block that repeated windows cover, by the FM-index of its shard."""

    def search(shard: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        sequences = [
            np.array([known.setdefault(word, len(known) + 1) for word in words.split(b" ")], np.int64)
            for words in shard.column("words").to_pylist()
        ]
        index = FmIndex(sequences, shard.column("weight").to_numpy(), window)
        sizes = [len(s) for s in sequences]
        flat = np.concatenate(index.matching_statistics(sequences)) >= window
        # Runs of window starts; they can't reach into the next block, whose end is nearer than a window.
        edges = np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1 + window
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.searchsorted(offsets, begin, side="right") - 1
        return pa.table({
            "leader": shard.column("leader").take(pa.array(owner)), "content": shard.column("content").take(pa.array(owner)),
            "begin": pa.array(begin - offsets[owner], pa.int64()), "end": pa.array(end - offsets[owner], pa.int64()),
        })

    kind = "leader bigint, content bigint, begin bigint, end bigint"
    return contents.groupBy("shard").applyInArrow(search, kind)


def _merged(spans: list[dict], size: int) -> tuple[np.ndarray, list[dict]]:
    """Which words the spans leave, and the spans united."""
    change = np.zeros(size + 1, np.int64)
    for span in spans:
        change[span["begin"]] += 1
        change[span["end"]] -= 1
    left = np.cumsum(change[:size]) == 0
    edges = np.diff(np.concatenate([[1], left.view(np.int8), [1]]))
    ends = zip(np.flatnonzero(edges == -1).tolist(), np.flatnonzero(edges == 1).tolist(), strict=True)
    return left, [{"start": a, "end": b} for a, b in ends]


def repeats_of_texts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per different text: key, tag, n_words, spans (array of start, end: the words that repeat) and kept, the others
    joined by one space."""
    texts = distinct_texts(docs)
    blocks = repeated_blocks(texts, common_grams(texts, window, gram), window, gram)
    found = stage_compressed(repeated_intervals(block_contents(texts, blocks, window), window), "intervals")
    placed = blocks.join(found, ["leader", "content"]).select("key", *_unpacked()[:2], "begin", "end")
    span = F.struct((F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"))
    spans = placed.groupBy("key", "tag").agg(F.collect_list(span).alias("spans"))
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("key", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pair)), ("kept", pa.string())])

    def make() -> Callable:
        def each(words: list[bytes], row: dict) -> Iterator[tuple]:
            size, united = len(words), []
            if row["spans"]:
                left, united = _merged(row["spans"], size)
                words = [words[at] for at in np.flatnonzero(left).tolist()]
            yield row["key"], row["tag"], size, united, b" ".join(words).decode()

        return each

    joined = texts.select("key", "tag", "text").join(spans.hint("shuffle_hash"), ["key", "tag"], "left")
    kind = "key bigint, tag bigint, n_words bigint, spans array<struct<start: bigint, end: bigint>>, kept string"
    return _over_words(joined, "text", kind, schema, make, 1_000)


def with_repeats(docs: DataFrame, of_texts: DataFrame) -> DataFrame:
    """doc_id and what ``of_texts`` has of the row's text (without key and tag)."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key"), text_tag().alias("tag"))
    return own.join(of_texts, ["key", "tag"]).drop("key", "tag")
