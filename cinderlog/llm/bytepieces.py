"""Token ids of many texts at once: pieces between single spaces are hashed over the bytes and looked up in arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cinderlog.llm.bytewords import _BYTES, _ODD, PIECE, _Powers, buffer
from cinderlog.llm.common import mixed

#: Bytes next to which a space is no border between pieces: ASCII white space, also the four separators.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


def other_spaces(column: pa.Array) -> np.ndarray:
    """Which texts hold white space beyond ASCII, next to which borders are not told from single bytes."""
    data, offsets = buffer(column)
    if len(data) < 3:
        data = np.append(data, [0, 0, 0]).astype(np.uint8)
    a, b, c = data[:-2], data[1:-1], data[2:]
    found = np.flatnonzero(a == 0xC2)
    found = found[np.isin(b[found], [0x85, 0xA0])]
    wide = np.flatnonzero((a == 0xE1) | (a == 0xE2) | (a == 0xE3))
    x, y, z = a[wide], b[wide], c[wide]
    blank = (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0xE2) & (y == 0x81) & (z == 0x9F)
    blank |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | np.isin(z, [0xA8, 0xA9, 0xAF]))
    at = np.concatenate([found, wide[blank]])
    if len(data) >= 2 and data[-2] == 0xC2 and data[-1] in (0x85, 0xA0):
        at = np.append(at, len(data) - 2)
    marked = np.zeros(len(column), bool)
    marked[np.searchsorted(offsets, at, "right") - 1] = True
    return marked


def holding(column: pa.Array, strings: list[str]) -> np.ndarray:
    """Which texts hold one of the strings."""
    found = np.zeros(len(column), bool)
    for string in strings:
        found |= pc.match_substring(column, string).fill_null(False).to_numpy(zero_copy_only=False)
    return found


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at texts, and at single spaces between two other characters."""
    spaces = np.flatnonzero(data == 0x20)
    spaces = spaces[(spaces > 0) & (spaces + 1 < len(data))]
    spaces = spaces[~_BLANK[data[spaces - 1]] & ~_BLANK[data[spaces + 1]]]
    ends = np.searchsorted(offsets, spaces, "right")
    inside = (offsets[ends - 1] < spaces) & (spaces + 1 < offsets[ends])
    texts = offsets[:-1][offsets[1:] > offsets[:-1]]
    return np.sort(np.concatenate([texts, spaces[inside]]))


def hashes_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number per piece; pieces follow one another without gaps."""
    found = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + PIECE, "right")) - 1)
        a, b = int(starts[first]), int(starts[last]) if last < len(starts) else len(data)
        up, down = _Powers.of(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[data[a:b]] * up[: b - a], out=sums[1:])
        start = starts[first:last] - a
        end = np.append(start[1:], b - a)
        found[first:last] = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)
        first = last
    return found


class PieceIds:
    """Ids of pieces: those met before lie in arrays sorted by hash, which are given up when they are beyond MOST_BYTES.

    encode gives the ids of whole texts; token_bytes the number of bytes each id stands for. New pieces that begin with a
    space and end without one are encoded JOINED together, and their ids cut apart where their bytes end.
    """

    MOST_BYTES, LONGEST, JOINED = 32 << 20, 64, 500

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], token_bytes: np.ndarray, kind: str, joins: bool = True):
        self.encode, self.token_bytes, self.kind, self.joins = encode, token_bytes, kind, joins
        self._forget()

    def _forget(self) -> None:
        self.hash, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bank = np.zeros(0, self.kind)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts and the n + 1 offsets of its texts in them."""
        data, offsets = buffer(column)
        starts = borders(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = hashes_of(data, starts)
        order = np.argsort(hashes)
        run = np.ones(len(order), bool)
        run[1:] = hashes[order][1:] != hashes[order][:-1]
        first = order[run]
        distinct, which = hashes[first], np.empty(len(order), np.int64)
        which[order] = np.cumsum(run) - 1
        at = np.minimum(np.searchsorted(self.hash, distinct), max(len(self.hash) - 1, 0))
        known = self.hash[at] == distinct if len(self.hash) else np.zeros(len(distinct), bool)
        start, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        start[known], count[known] = self.start[at[known]], self.count[at[known]]
        bank, new = self.bank, np.flatnonzero(~known)
        if len(new):
            size = ends[first[new]] - starts[first[new]]
            by_size = np.argsort(size > self.LONGEST, kind="stable")
            new, size = new[by_size], size[by_size]
            ids, count[new] = self._learn(data, starts[first[new]], size)
            start[new] = len(bank) + np.cumsum(count[new]) - count[new]
            bank = np.concatenate([bank, ids])
            self._keep(distinct, start, count, bank, new[: int((size <= self.LONGEST).sum())])
        start, count = start[which], count[which]
        through = np.concatenate([[0], np.cumsum(count)])
        flat = bank[np.repeat(start - through[:-1], count) + np.arange(through[-1])]
        return flat, through[np.searchsorted(starts, offsets)]

    def _keep(self, distinct: np.ndarray, start: np.ndarray, count: np.ndarray, bank: np.ndarray, kept: np.ndarray) -> None:
        if not len(kept):
            return
        self.bank = bank[: start[kept[-1]] + count[kept[-1]]]
        kept = np.sort(kept)
        at = np.searchsorted(self.hash, distinct[kept])
        self.hash = np.insert(self.hash, at, distinct[kept])
        self.start = np.insert(self.start, at, start[kept])
        self.count = np.insert(self.count, at, count[kept])
        if self.bank.nbytes + 24 * len(self.hash) > self.MOST_BYTES:
            self._forget()

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given pieces, one after another, and how many each has."""
        join = (data[start] == 0x20) & ~_BLANK[data[start + size - 1]] & self.joins
        together = np.flatnonzero(join)
        counts = np.zeros(len(start), np.int64)
        parts, order, alone = [], [], [np.flatnonzero(~join)]
        groups = [together[k : k + self.JOINED] for k in range(0, len(together), self.JOINED)]
        through = [np.cumsum(size[group]) for group in groups]
        texts = [data[np.repeat(start[g] - t + size[g], size[g]) + np.arange(t[-1])].tobytes().decode() for g, t in zip(groups, through)]
        for group, ends, ids in zip(groups, through, self.encode(texts) if texts else []):
            reached = np.cumsum(self.token_bytes[ids])
            cuts = np.searchsorted(reached, ends)
            if len(ids) and reached[-1] == ends[-1] and (reached[cuts] == ends).all():
                counts[group] = np.diff(cuts, prepend=-1)
                parts.append(ids)
                order.append(group)
            else:  # not a byte-level vocabulary
                alone.append(group)
        rest = np.concatenate(alone)
        ids = self.encode([data[a : a + n].tobytes().decode() for a, n in zip(start[rest].tolist(), size[rest].tolist())]) if len(rest) else []
        counts[rest] = list(map(len, ids))
        flat = np.concatenate([*parts, *ids]).astype(self.kind, copy=False)
        order = np.concatenate([*order, rest])
        begins = np.empty(len(start), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        index = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return flat[index], counts
