"""Wavelet matrix over token ids (Claude, Navarro and Ordonez, 2015), vectorised with numpy.

One bit-plane per bit of the ids, highest first; each plane orders the ids by the bits above it. Beside the packed
bits stand cumulated ones per block, so that rank takes a lookup and a popcount within one block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK_BYTES = 64


@dataclass(frozen=True)
class Plane:
    zeros: int
    bits: bytes
    ranks: bytes


def _ranks(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of the packed plane."""
    ones = np.bitwise_count(packed)
    blocks = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK_BYTES), dtype=np.uint32) if len(ones) else ones
    return np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")


def build(ids: np.ndarray) -> list[Plane]:
    """Planes of a sequence of unsigned ids; none for an empty sequence."""
    if len(ids) == 0:
        return []
    width = max(1, int(ids.max()).bit_length())
    order = ids.astype(np.uint16 if width <= 16 else np.uint32)
    planes = []
    for bit in range(width - 1, -1, -1):
        ones = (order >> bit) & 1 != 0
        packed = np.packbits(ones, bitorder="little")
        # compress takes indices first, which random bits don't slow down.
        zeros = order.compress(~ones)
        planes.append(Plane(len(zeros), packed.tobytes(), _ranks(packed).tobytes()))
        order = np.concatenate([zeros, order.compress(ones)])
    return planes


class WaveletMatrix:
    """Access, counting and lookup on stored planes without decoding the sequence."""

    def __init__(self, planes: list[Plane], length: int):
        self.length, self.width = length, len(planes)
        self.zeros = [plane.zeros for plane in planes]
        self.bits = [np.frombuffer(plane.bits, np.uint8) for plane in planes]
        self.ranks = [np.frombuffer(plane.ranks, "<u4") for plane in planes]

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up: each plane tells how the order below it was split."""
        order = np.zeros(self.length, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self.bits[level], count=self.length, bitorder="little").view(bool)
            above = np.empty_like(order)
            above[np.flatnonzero(~ones)] = order[: self.zeros[level]]
            above[np.flatnonzero(ones)] = order[self.zeros[level] :] | order.dtype.type(1 << (self.width - 1 - level))
            order = above
        return order.astype(np.uint32)

    def _bit(self, level: int, at: int) -> int:
        return int(self.bits[level][at >> 3]) >> (at & 7) & 1

    def _ones(self, level: int, end: int) -> int:
        """Ones in the first ``end`` bits of a plane."""
        byte = end >> 3
        block = byte // BLOCK_BYTES
        count = int(self.ranks[level][block])
        count += int(np.bitwise_count(self.bits[level][block * BLOCK_BYTES : byte]).sum(dtype=np.int64))
        if end & 7:
            count += (int(self.bits[level][byte]) & ((1 << (end & 7)) - 1)).bit_count()
        return count

    def _position(self, level: int, kth: int, bit: int) -> int:
        """Place of the ``kth`` (from 0) bit of this value in a plane, by binary search on rank."""
        low, high = 0, self.length
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > kth:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, at: int) -> int:
        if not 0 <= at < self.length:
            raise IndexError(at)
        value = 0
        for level in range(self.width):
            bit = self._bit(level, at)
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` within [start, end) stand below the last plane."""
        if token < 0 or token.bit_length() > self.width:
            return 0, 0
        for level in range(self.width):
            before, until = self._ones(level, start), self._ones(level, end)
            if token >> (self.width - 1 - level) & 1:
                start, end = self.zeros[level] + before, self.zeros[level] + until
            else:
                start, end = start - before, end - until
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        low, high = self._range(token, start, self.length if end is None else end)
        return high - low

    def locate(self, token: int) -> list[int]:
        """Ascending positions of ``token``."""
        low, high = self._range(token, 0, self.length)
        found = []
        for at in range(low, high):
            for level in range(self.width - 1, -1, -1):
                if token >> (self.width - 1 - level) & 1:
                    at = self._position(level, at - self.zeros[level], 1)
                else:
                    at = self._position(level, at, 0)
            found.append(at)
        return found
