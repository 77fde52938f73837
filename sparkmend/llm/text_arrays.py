"""Texts as numpy arrays: the words of a batch of texts, hashed without a Python step a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BREAKS = np.zeros(256, bool)
BREAKS[[0x20, *range(0x09, 0x0E)]] = True
# 64-bit values of the bytes and the base of the word hash: drawn once from a fixed seed.
_RANDOM = np.random.Generator(np.random.Philox(key=2024))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_BYTE[BREAKS] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with at most ``most`` in all, or one item that is larger."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class Batch:
    """Bytes of several texts, one break between two texts, and their words ``[^\\x20\\x09-\\x0D]+``.

    ``data``; ``text_start``/``text_end`` (bytes of each text); ``start``/``end`` (bytes of each word);
    ``owner`` (text of each word); ``first`` (first word of each text, with one entry more at the end).
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b" ".join(texts) + b" ", "uint8")
        size = np.fromiter(map(len, texts), "int64", len(texts))
        self.text_end = np.cumsum(size + 1) - 1
        self.text_start = self.text_end - size
        inside = ~BREAKS[self.data]
        edge = np.flatnonzero(np.diff(inside.astype("int8"), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.append(self.text_start, len(self.data)), "left")
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.start):
            return np.zeros(0, "uint64")
        at = np.arange(self.start[0], len(self.data)) - np.repeat(
            self.start, np.diff(np.append(self.start, len(self.data))))
        powers = np.multiply.accumulate(np.full(int(at.max()) + 1, _BASE, "uint64"))
        values = _BYTE[self.data[self.start[0]:]] * powers[at]
        return mixed(np.add.reduceat(values, self.start - self.start[0]))


class HashIndex:
    """Positions of distinct 64-bit keys, found by linear probing in whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys.astype("uint64"), np.uint64(0))
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, "int32")
        todo = np.arange(len(keys))
        slot = self._home(self.keys[:-1])
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = free  # of several, the last one stays
            todo = todo[self.slots[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype("int64")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        slot = self._home(keys)
        at = self.slots[slot]
        todo = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at[todo] = self.slots[slot[todo]]
            todo = todo[(at[todo] >= 0) & (self.keys[at[todo]] != keys[todo])]
        return at
