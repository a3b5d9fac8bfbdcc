"""Words of many texts at once, found and hashed with numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cinderlog.llm.common import mixed

#: Bytes looked at together; what a piece needs beside its bytes (about 50 bytes for each) stays bounded by this.
PIECE = 1 << 19
_BASE, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: A random number for each byte, so that differences of words have no structure of their own.
_BYTES = np.random.default_rng(9).integers(0, 1 << 64, 256, np.uint64)
#: The six ASCII spaces.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the n + 1 offsets of its texts; null texts are empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about PIECE bytes that end with a text, or behind a space within one."""
    start, end = 0, len(data)
    while start < end:
        stop = min(start + PIECE, end)
        if stop < end:
            last = offsets[np.searchsorted(offsets, stop, "right") - 1]
            if last > start:
                stop = int(last)
            else:
                text_end = int(offsets[np.searchsorted(offsets, start, "right")])
                while stop < text_end:
                    spaces = np.flatnonzero(SPACES[data[stop : stop + PIECE]])
                    if len(spaces):
                        stop += int(spaces[0]) + 1
                        break
                    stop += PIECE
                stop = min(stop, text_end)
        yield start, stop
        start = stop


class _Powers:
    """Powers of the base and of its inverse, as many as have been asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            cls.up, cls.down = np.full(n + 1, _BASE), np.full(n + 1, _BACK)
            cls.up[0] = cls.down[0] = 1
            np.cumprod(cls.up, out=cls.up)
            np.cumprod(cls.down, out=cls.down)
        return cls.up, cls.down


class ByteWords:
    """All words of a column of texts: `start` and `end` in the bytes, `hash`, and `text_no`, the row each is in."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = buffer(column)
        found = [self._piece(a, b) for a, b in _pieces(self.data, self.offsets)]
        self.start, self.end, self.hash = (
            np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64 if i == 2 else np.int64) for i in range(3)
        )
        self.text_no = np.searchsorted(self.offsets, self.start, "right") - 1
        self.per_text = np.bincount(self.text_no, minlength=len(column))

    def _piece(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = self.data[a:b]
        inside = ~SPACES[data]
        edges = np.zeros(b - a + 1, bool)
        edges[0] = inside[0]
        edges[1:-1] = inside[1:] != inside[:-1]
        edges[-1] = inside[-1]
        cuts = self.offsets[np.searchsorted(self.offsets, a, "right") : np.searchsorted(self.offsets, b, "left")] - a
        cuts = np.unique(cuts)
        joined = cuts[inside[cuts] & inside[cuts - 1]]  # a text ends within a word and the next begins with one
        at = np.flatnonzero(edges)
        if len(joined):
            at = np.sort(np.concatenate([at, joined, joined]))
        start, end = at[::2], at[1::2]
        up, down = _Powers.of(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: b - a], out=sums[1:])
        hashes = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD
        return start + a, end + a, mixed(hashes)

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """How many of the bytes marked in a table of 256 each text has."""
        total = np.zeros(len(self.offsets) - 1, np.int64)
        for a, b in _pieces(self.data, self.offsets):
            at = np.flatnonzero(marks[self.data[a:b]]) + a
            total += np.bincount(np.searchsorted(self.offsets, at, "right") - 1, minlength=len(total))
        return total
