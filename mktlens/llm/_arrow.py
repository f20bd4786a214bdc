"""Arrow and numpy helpers shared by the operators' task-side functions.

Texts are read straight from Arrow's UTF-8 buffers, in slices bounded by bytes,
so that one long text or a batch of many never multiplies a task's memory by
more than the slice size (a text longer than a slice is a slice of its own).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20

# Fixed odd multipliers: polynomial base of the rolling hash and two mixers.
BASE = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
M64 = (1 << 64) - 1


def filled(arr: pa.Array) -> pa.Array:
    """A string array with nulls read as the empty text."""
    return pc.fill_null(arr, "") if arr.null_count else arr


def buffer_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets of each text in them)."""
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    if offsets is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut every batch into runs of rows of at most ``limit`` bytes of text (one
    row at least); yields (rows, bytes, offsets) with null texts read as empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(column)
        text = filled(batch.column(at))
        _, off = buffer_of(text)
        start = 0
        while start < len(text):
            end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), len(text))
            raw, own = buffer_of(text.slice(start, end - start))
            yield batch.slice(start, end - start), raw, own
            start = end


def carried(df: DataFrame, name: str | None) -> tuple[list, str]:
    """A column that an operator hands through as it is: (to select, for a schema)."""
    if name is None:
        return [], ""
    return [F.col(name).alias("_carry")], f"_carry {df.schema[name].dataType.simpleString()}, "


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)

            def powers(base: int) -> np.ndarray:
                p = np.full(n, base, np.uint64)
                p[0] = 1
                return np.multiply.accumulate(p)

            self.up, self.down = powers(BASE), powers(pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a fresh array): spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


#: Ranges longer than this are hashed one by one where a hash tells texts apart: sums
#: modulo 2**64 collide on crafted (Thue-Morse) ranges of 1,024 bytes and more.
LONG_RANGE = 512


class RollingHash:
    """64-bit hashes of arbitrary byte ranges of one buffer from prefix sums."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self.raw = raw
        up, self.down = POWERS.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = BYTE_VALUES[raw]
        terms *= up[:n]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= self.down[start]
        h += (end - start).astype(np.uint64) * np.uint64(MIX_B)
        return mix(h)

    def firm(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """As ``of``, with long ranges hashed one by one."""
        h = self.of(start, end)
        for i in np.flatnonzero(end - start > LONG_RANGE).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.raw[start[i] : end[i]].tobytes())
        return h

    def all(self, k: int) -> np.ndarray:
        """Hashes of every range of ``k`` bytes, by start: sums of random byte values
        times powers, which are spread evenly as they are."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = self.sums[k:] - self.sums[:n]
        h *= self.down[:n]
        return h
