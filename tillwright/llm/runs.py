"""Periodic runs of words by Baier grouping, and texts with the repeats of their runs dropped.

Phase one of Baier's suffix sorter (2016) splits groups of suffixes until each group holds the suffixes that start with
the same longest Lyndon word; the lengths of these words are the Lyndon array. It is taken under the order of the word
numbers and under the reverse order. Every run has a Lyndon root that is the longest Lyndon word at its places under one
of the two (Bannai et al., 2017), and equal roots are in one group. A run of four periods or more holds a root three
times in a row; each such row is extended to both sides by the longest common extension of its ends.

A word that a text has fewer than four times is in no run of four periods, so texts are cut at such words first, and
the pieces again at words that are rare in the piece, until nothing changes. What is left is little but for repetitive
texts, and takes time linear in its words; the extension stays within one period each side, which for runs of three
periods and more adds up to at most n log n comparisons.

Words are runs of anything but ASCII white space, unchanged. Null and empty texts have no words and no runs. Repeated
rows give one row each, null ids are kept. Very long texts take memory in proportion to their words, one text at a
time. A run is the same however ties between words are ordered. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import in_chunks, texts_of, whole_text

# A run counts from so many periods and words on. The cut at rare words and the three roots in a row need four periods.
PERIODS = 4
LEAST_WORDS = 6
# Words compared at once when a run is extended.
STRIDE = 64

Run = tuple[int, int, int]  # start, length, period


def word_numbers(words: list) -> np.ndarray:
    """Words as numbers; equal words have equal numbers."""
    known: dict = {}
    return np.array([known.setdefault(word, len(known)) for word in words], np.int64)


def lyndon_groups(values: list[int]) -> tuple[list[int], list[int]]:
    """Phase one of Baier's sorter: per position the length of the longest Lyndon word there and the group of that word.

    ``values`` are numbers 0..k-1, each present. Groups are taken from the highest down. A position leaves the list of
    positions when its group is taken, so its neighbour to the left is then the nearest position of a lower group; that
    one's word grows by the words of the group that point to it, and those that grow alike form a group right above
    their old one.
    """
    size = len(values)
    left, right = list(range(-1, size)), list(range(1, size + 2))
    group = list(values)
    distinct = max(values) + 1 if size else 0
    members: list[list[int]] = [[] for _ in range(distinct)]
    for at, value in enumerate(values):
        members[value].append(at)
    length = [1] * distinct
    below, above = list(range(-1, distinct - 1)), list(range(1, distinct + 1))
    current = distinct - 1
    while current >= 0:
        pointed: dict[int, int] = {}
        for at in members[current]:
            if group[at] == current:
                before, after = left[at], right[at]
                right[before] = after
                left[after] = before
                if before >= 0:
                    pointed[before] = pointed.get(before, 0) + 1
        # The most words first: each new group stands right above the old one and below those made before it.
        for times in sorted(set(pointed.values()), reverse=True):
            made: dict[int, int] = {}
            for at, n in pointed.items():
                if n != times:
                    continue
                old = group[at]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(length)
                    length.append(length[old] + times * length[current])
                    members.append([])
                    below.append(old)
                    above.append(above[old])
                    below[above[old]] = above[old] = new
                group[at] = new
                members[new].append(at)
        current = below[current]
    return [length[g] for g in group], group


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sequences have in common from their start on."""
    size = min(len(a), len(b))
    for at in range(0, size, STRIDE):
        unequal = np.flatnonzero(a[at : min(at + STRIDE, size)] != b[at : min(at + STRIDE, size)])
        if len(unequal):
            return at + int(unequal[0])
    return size


def _piece_runs(values: np.ndarray) -> set[Run]:
    """Runs of at least ``PERIODS`` periods of one piece."""
    _, numbers = np.unique(values, return_inverse=True)
    found: set[Run] = set()
    for ordered in (numbers, numbers.max() - numbers):
        lengths, groups = map(np.array, lyndon_groups(ordered.tolist()))
        # Two equal Lyndon words in a row, and then a third.
        at = np.flatnonzero(np.arange(len(groups)) + lengths < len(groups))
        linked = np.zeros(len(groups), bool)
        linked[at] = groups[at + lengths[at]] == groups[at]
        twice = at[linked[at]]
        twice = twice[linked[twice + lengths[twice]]]
        behind = np.zeros(len(groups), bool)
        behind[twice + lengths[twice]] = groups[twice + lengths[twice]] == groups[twice]
        for start in twice[~behind[twice]].tolist():
            period = int(lengths[start])
            low = start - _common(values[:start][::-1], values[: start + period][::-1])
            high = start + period + _common(values[start:], values[start + period :])
            if high - low >= PERIODS * period:
                found.add((low, high - low, period))
    return found


def _pieces(values: np.ndarray) -> list[np.ndarray]:
    """Positions of the stretches in which every word stands at least ``PERIODS`` times in its stretch."""
    at = np.arange(len(values))
    while len(at):
        piece = np.cumsum(np.concatenate([[0], np.diff(at) != 1]))
        key = piece * (int(values.max()) + 1) + values[at]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        kept = count[which] >= PERIODS
        if kept.all():
            return np.split(at, np.flatnonzero(np.diff(at) != 1) + 1)
        at = at[kept]
    return []


def find_runs(values: np.ndarray, least_words: int = LEAST_WORDS) -> list[Run]:
    """All maximal runs (start, length, smallest period) of at least ``PERIODS`` periods and ``least_words`` words."""
    found: set[Run] = set()
    for piece in _pieces(values):
        if len(piece) >= max(PERIODS, least_words):
            offset = int(piece[0])
            found.update((offset + start, length, period) for start, length, period in _piece_runs(values[piece]))
    return sorted(run for run in found if run[1] >= least_words)


def kept_words(size: int, runs: list[Run]) -> np.ndarray:
    """Which of ``size`` words stay if each run keeps its first period only (words two runs cover need both)."""
    change = np.zeros(size + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:size]) == 0


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and text, the kept words of ``text`` joined by one space."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("text", pa.string())])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    words = text.encode().split()
                    runs = find_runs(word_numbers(words)) if len(words) >= LEAST_WORDS else []
                    kept = words
                    if runs:
                        kept = [words[at] for at in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                    named = [{"start": s, "length": n, "period": p} for s, n, p in runs]
                    yield doc_id, len(words), named, b" ".join(kept).decode()

        yield from in_chunks(rows(), schema, 1_000)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    kind = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"
    return texts.mapInArrow(collapse, kind)
