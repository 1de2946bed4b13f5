"""Word and shingle hashes of whole Arrow columns of text, computed with numpy inside Spark tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit polynomial sums over prefix
sums, so any window costs two look-ups whatever its length; equal hashes are taken as equal content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text handled at once; one longer document is handled alone.
SLICE_BYTES = 1 << 18

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the splitmix64 finaliser), in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse; those for a slice are kept, more are made for a long document alone."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        if n > len(up):
            size = max(n, SLICE_BYTES + 1)
            up, down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                for b in (self.base, self.inverse)
            )
            if size == SLICE_BYTES + 1:
                self.up, self.down = up, down
        return up[:n], down[:n]


_bytes_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)
_PLAIN = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of consecutive documents: byte ranges, hashes, and each document's first word."""

    def __init__(self, column: pa.Array, fold_case: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = int(offsets[0])
        size = int(offsets[-1]) - at
        self.data = np.frombuffer(column.buffers()[2], np.uint8, size, at) if size else np.empty(0, np.uint8)
        self.offsets = offsets - at
        solid = ~_SPACE[self.data]
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], solid])[:-1] if size else solid
        after = np.concatenate([solid, [False]])[1:] if size else solid
        self.starts = np.flatnonzero(solid & (edge[:-1] | ~before))
        self.ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
        up, down = _bytes_powers.upto(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((_FOLDED if fold_case else _PLAIN)[self.data] * up[:size], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.first = np.searchsorted(self.starts, self.offsets)
        self._sums: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the word sequences from the word numbers `starts`, each `length` words long."""
        n = len(self.hashes)
        up, down = _word_powers.upto(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hashes * up[:n], out=self._sums[1:])
        raw = (self._sums[starts + length] - self._sums[starts]) * down[starts]
        return mix(raw + np.asarray(length).astype(np.uint64) * np.uint64(0x165667B19E3779F9))

    def rolling(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All starts of `length`-word windows inside one document, and each one's document number."""
        n = np.maximum(self.counts() - length + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        return self.first[:-1][doc] + within, doc


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold at most `limit` bytes, or one row."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
    lo = total = 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(lengths):
        yield lo, len(lengths)
