"""Per-worker table of tokenised text pieces.

Both public tokenizers cut a text at white space before they merge, so a text's
ids are those of its pieces one after another.  A piece that was met before in
the same Python worker is looked up by a 64-bit hash of its bytes (numpy, whole
slices at a time); only new pieces reach the tokenizer, in batches.  The table
is emptied when it holds ``limit`` pieces or ``pool`` ids: bounded memory.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

from mktlens.llm._arrow import RollingHash

SPACE, TAB, LF, CR = 0x20, 0x09, 0x0A, 0x0D
IS_GAP = np.zeros(256, bool)
IS_GAP[[SPACE, TAB, LF, CR]] = True


class PieceTable:
    """``encode`` gives the ids of each piece, or with ``lengths_only`` their number."""

    def __init__(self, encode: Callable[[list[bytes]], list], lengths_only: bool = False, limit: int = 2_000_000, pool: int = 16_000_000) -> None:
        self.encode, self.lengths_only, self.limit, self.pool = encode, lengths_only, limit, pool
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def rows(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The table row of each piece raw[start:end], after adding new ones."""
        keys, first, inverse = np.unique(RollingHash(raw).of(start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit or len(self.ids) > self.pool:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            own = first[new]
            data = raw.tobytes()
            got = self.encode([data[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())])
            count = np.fromiter(got if self.lengths_only else map(len, got), np.int64, len(got))
            base = len(self.ids)
            if not self.lengths_only:
                self.ids = np.concatenate([self.ids, *got])
            place = at[new]
            self.keys = np.insert(self.keys, place, keys[new])
            self.start = np.insert(self.start, place, base + np.cumsum(count) - count)
            self.count = np.insert(self.count, place, count)
            at = np.searchsorted(self.keys, keys)
        return at[inverse]


def gather(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of ids[start:start+count] of every piece."""
    total = int(count.sum())
    ends = np.cumsum(count)
    where = np.arange(total, dtype=np.int64) + np.repeat(start - (ends - count), count)
    return ids[where]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without space, tab, line feed or carriage return; never across texts."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_GAP[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def spaced_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in pieces at which a byte-level tokenizer with the pattern
    `` ?letters| ?digits| ?others|white space`` always cuts: a word with the one
    space before it; of other white space before a word, the last character
    apart from the rest.  Never across texts."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = IS_GAP[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    inner = ~edge[1:n]  # bytes i and i+1 belong to one text
    begin = np.zeros(n + 1, bool)
    begin[off] = True
    begin[1:n] |= inner & gap[1:] & ~gap[:-1]  # white space after a word
    begin[: n - 1] |= inner & gap[:-1] & ~gap[1:]  # the last white space before a word
    begin[1:n] |= inner & ~gap[1:] & gap[:-1] & (raw[:-1] != SPACE)  # a word after other white space than a space
    start = np.flatnonzero(begin[:n])
    return start, np.append(start[1:], n)
