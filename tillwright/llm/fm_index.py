"""FM-index of a shard: the Burrows-Wheeler transform as a wavelet tree, backward search and matching statistics.

The transform of the shard's sequences is kept level by level, one bit-plane per bit of the symbols with cumulated ones
per 64 bits (the wavelet tree laid out as a matrix). Searching is vectorised over many queries: each step extends all
of them by one symbol to the left. Suffixes are ordered by their first ``depth`` symbols, which is all that patterns up
to that length can tell apart.
"""

from __future__ import annotations

import numpy as np

TERMINATOR = 0


class _Level:
    """One bit-plane with ranks."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        words = np.zeros(len(packed) // 8 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)]).astype(np.uint32)
        self.zeros = len(ones) - int(np.count_nonzero(ones))

    def rank(self, ends: np.ndarray) -> np.ndarray:
        """Ones among the first ``ends`` bits."""
        word = ends >> 6
        mask = (np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """Index of ``sequences`` (arrays of symbols from 1 on), the occurrences of each counting ``weights`` times."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, depth: int):
        sizes = np.array([len(s) + 1 for s in sequences], np.int64)
        ends = np.cumsum(sizes)
        text = np.zeros(int(sizes.sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        if len(sequences):
            text[inside] = np.concatenate(sequences)
        self.depth, self.size = depth, len(text)
        order, ranks = _sorted_suffixes(text, depth)
        until_end = np.repeat(ends - 1, sizes) - np.arange(len(text))
        self._shared_prefixes(order, ranks, until_end)
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(weights, sizes)[order])])
        self.symbols = int(text.max()) + 1 if len(text) else 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self._build_tree(text[order - 1])

    def _shared_prefixes(self, order: np.ndarray, ranks: list[np.ndarray], until_end: np.ndarray) -> None:
        """``lcp``: symbols that neighbours in suffix order share, without terminators and up to ``depth``; and for each
        place the nearest places before and behind with a smaller value."""
        low, high = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(low), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            rank, width = ranks[level], 1 << level
            inside = (low < self.size) & (high < self.size)
            equal = np.zeros(len(low), bool)
            equal[inside] = rank[low[inside]] == rank[high[inside]]
            low[equal] += width
            high[equal] += width
            shared[equal] += width
        shared = np.minimum(np.minimum(shared, until_end[order[:-1]]), self.depth)
        self.lcp = np.concatenate([[-1], shared, [-1]]) if self.size else np.array([-1, -1])
        self.previous, self.next = np.zeros(self.size + 1, np.int64), np.full(self.size + 1, self.size)
        for value in range(self.depth + 1):
            at = np.flatnonzero(self.lcp == value)
            if len(at):
                lower = np.flatnonzero(self.lcp < value)
                behind = np.searchsorted(lower, at)
                self.previous[at], self.next[at] = lower[behind - 1], lower[behind]

    def _build_tree(self, transform: np.ndarray) -> None:
        self.width = max(1, (self.symbols - 1).bit_length())
        self.levels = []
        for bit in range(self.width - 1, -1, -1):
            ones = (transform >> bit) & 1 != 0
            self.levels.append(_Level(ones))
            transform = np.concatenate([transform[~ones], transform[ones]])
        symbols = np.arange(self.symbols)
        self.base = self._descend(np.zeros(self.symbols, np.int64), symbols)

    def _descend(self, places: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where places of the transform stand below the last level, following the bits of the symbols."""
        for level, plane in enumerate(self.levels):
            ones = plane.rank(places)
            places = np.where((symbols >> (self.width - 1 - level)) & 1, plane.zeros + ones, places - ones)
        return places

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals [low, high) of patterns with one more symbol to their left."""
        both = self._descend(np.concatenate([low, high]), np.concatenate([symbols, symbols]))
        offset = self.smaller[symbols] - self.base[symbols]
        return both[: len(low)] + offset, both[len(low) :] + offset

    def matching_statistics(self, sequences: list[np.ndarray], least_weight: int = 2) -> list[np.ndarray]:
        """Per sequence and position: how many symbols from there on (up to ``depth``) the index has with at least
        ``least_weight``. Symbols may be unknown (negative)."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int64)
        found = np.zeros(len(flat), np.int64)
        first, at = begin[:-1][sizes > 0], begin[1:][sizes > 0] - 1
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.size)
        match = np.zeros(len(at), np.int64)
        while len(at):
            # A full match gives up its last symbol before it can grow to the left.
            full = match == self.depth
            if full.any():
                self._shorten(low, high, match, np.flatnonzero(full), self.depth - 1)
            symbol = flat[at]
            known = (symbol > TERMINATOR) & (symbol < self.symbols)
            longer_low, longer_high = self.extend(low, high, np.where(known, symbol, 0))
            good = known & (self.weight[longer_high] - self.weight[longer_low] >= least_weight)
            low[good], high[good] = longer_low[good], longer_high[good]
            match[good] += 1
            found[at[good]] = match[good]
            stuck = ~good & (match > 0)
            if stuck.any():
                self._shorten(low, high, match, np.flatnonzero(stuck), None)
            at = at - ~stuck
            left = at >= first
            if not left.all():
                at, first, low, high, match = at[left], first[left], low[left], high[left], match[left]
        return np.split(found, begin[1:-1]) if len(sequences) else []

    def _shorten(self, low, high, match, which: np.ndarray, to: int | None) -> None:
        """The parent intervals of some patterns, or, with ``to``, the patterns cut to so many symbols."""
        left, right = self.lcp[low[which]], self.lcp[high[which]]
        place, shared = np.where(left >= right, low[which], high[which]), np.maximum(left, right)
        if to is not None:
            moved = shared >= to
            match[which] = to
            which, place = which[moved], place[moved]
        else:
            match[which] = shared
        low[which], high[which] = self.previous[place], self.next[place]


def _sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes by their first ``depth`` symbols at least, by prefix doubling, and their ranks by 1, 2, 4, ... symbols."""
    _, rank = np.unique(text, return_inverse=True)
    ranks, width = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while width < depth and len(text):
        after = np.zeros(len(text), np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        steps = np.diff(key[order]) != 0
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(steps)])
        ranks.append(rank.astype(np.int32))
        width *= 2
    return order, ranks
