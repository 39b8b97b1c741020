"""Sampled positions of byte strings, for the repeat finder.

A difference cover picks positions so that any two equal windows have a picked position at a common
offset.  The positions here are picked by content: the least hash among the ``WINDOW - GRAM + 1``
grams of a window.  Equal windows hold equal grams, so they share a picked position at the same
offset, at about 6 positions in 100 bytes instead of the 19 or more of a cover by index.

Texts of a batch lie end to end in one buffer and are worked on in slices of ``SLICE`` bytes with a
margin, so a text of any length takes as much memory as a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 50
GRAM = 20
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


class GramHasher:
    """Polynomial hashes modulo 2**64 of all grams, with powers kept between calls."""

    def __init__(self, seed: int = 2024) -> None:
        self._bytes = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self._up = self._down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), 1 << 12)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64) * _MIX

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Sums of the first k terms, from which ``strings`` takes the hash of any string of ``data``."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._bytes[data] * self._up[: len(data)], out=out[1:])
        return out

    def strings(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]`` for each pair; equal strings have equal hashes wherever they lie."""
        return (sums[ends] - sums[starts]) * self._down[starts]

    def of_length(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = max(0, len(sums) - length)
        return (sums[length:] - sums[:n]) * self._down[:n]

    def grams(self, data: np.ndarray, length: int = GRAM) -> np.ndarray:
        """Hash of ``data[i:i+length]`` for every i, best in its high bits; empty when data is shorter."""
        return self.of_length(self.sums(data), length)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every run of ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = pick(x[: len(x) - (width - have)], x[width - have :])
    return x


def sampled(h: np.ndarray, window: int = WINDOW, gram: int = GRAM, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions that hold the least gram hash (every tie of its high half) of at least one (valid) window."""
    width = window - gram + 1
    if len(h) < width:
        return np.zeros(0, np.int64)
    high = (h >> np.uint64(32)).astype(np.uint32)
    least = _slide(high, width, np.minimum)
    if valid is not None:
        least = np.where(valid, least, 0)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint32)
    padded[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero(_slide(padded, width, np.maximum) == high)


class Texts:
    """The texts of an Arrow column, end to end; places are offsets into ``data``."""

    def __init__(self, column: pa.Array) -> None:
        column = column.fill_null(b"")
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        body = column.buffers()[2]
        whole = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data, self.offsets = whole[offsets[0] : offsets[-1]], offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The number of the text that each place lies in."""
        return np.searchsorted(self.offsets, places, side="right") - 1

    def slices(self, margin: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, start with margin, end with margin) of all slices."""
        n = len(self.data)
        for a in range(0, n, SLICE):
            b = min(a + SLICE, n)
            yield a, b, max(0, a - margin[0]), min(n, b + margin[1])

    def samples(self, hasher: GramHasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Per slice: sampled places, their gram hashes, the slice's sums and the place where those begin."""
        side = WINDOW - GRAM
        for a, b, lo, hi in self.slices((side, WINDOW)):
            sums = hasher.sums(self.data[lo:hi])
            h = hasher.of_length(sums, GRAM)
            valid = np.ones(max(0, hi - lo - WINDOW + 1), bool)
            ends = self.offsets[np.searchsorted(self.offsets, lo, side="right") : np.searchsorted(self.offsets, hi, side="left")]
            across = (ends[:, None] - lo - np.arange(1, WINDOW)).ravel()
            valid[across[(across >= 0) & (across < len(valid))]] = False
            at = sampled(h, valid=valid)
            at = at[(at >= a - lo) & (at < b - lo)]
            at = at[at + lo + GRAM <= self.offsets[self.owner(at + lo) + 1]]
            yield at + lo, h[at], sums, lo
