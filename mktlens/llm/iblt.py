"""Document fingerprints: invertible Bloom lookup tables of paragraph digests."""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktlens.llm._arrow import M64, MIX_A, RollingHash, mix
from mktlens.session import cut_lineage

HASHES = 3
BASE_CELLS = 12  # of a fingerprint; a comparison that does not peel is retried with GROWTH times as many
GROWTH = 4
CONTEXT = 8  # bytes that decide a cut inside a long paragraph
CUT_MASK = 63  # one cut in so many bytes, on average
CHECK_BITS = 32
ENOUGH = 4  # cells a paragraph; pairs that do not peel then are counted exactly
ROUNDS = 100
GROUP_BYTES = 1 << 20


def paragraphs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit digest of every paragraph, offsets of each text in them).

    A paragraph ends at a line break; a long one also where the hash of the last
    CONTEXT bytes says so, wherever it stands, so that an edit moves no cut but
    its own.  Paragraphs that repeat within a text are told apart by number."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    rolling = RollingHash(raw)
    begin = np.zeros(n + 1, bool)
    begin[1:] |= raw == 0x0A
    begin[CONTEXT:] |= (rolling.all(CONTEXT) & np.uint64(CUT_MASK)) == 0
    begin[off] = True
    start = np.flatnonzero(begin[:n])
    # a context must lie inside the text
    inside = start - off[np.searchsorted(off, start, side="right") - 1]
    start = start[(inside == 0) | (inside >= CONTEXT) | (raw[start - 1] == 0x0A)]
    h = rolling.firm(start, np.append(start[1:], n))
    poff = np.searchsorted(start, off)
    own = np.repeat(np.arange(len(off) - 1), np.diff(poff))
    order = np.lexsort((h, own))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    at = np.arange(len(h))
    number = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty(len(h), np.uint64)
    out[order] = mix(h[order] + number.astype(np.uint64) * np.uint64(MIX_A))
    return out, poff


def check(digest: np.ndarray) -> np.ndarray:
    """Summed beside the digests, so that a lone digest in a cell shows itself."""
    return mix(digest + np.uint64(0x51ED27)) & np.uint64((1 << CHECK_BITS) - 1)


def cells_of(digest: np.ndarray, cells: int) -> np.ndarray:
    """HASHES cells of each digest, one in each part of the table."""
    part = cells // HASHES
    seeds = [np.uint64(MIX_A * (cells * HASHES + r) & M64) for r in range(HASHES)]
    return np.stack([mix(digest + seed) % np.uint64(part) + np.uint64(r * part) for r, seed in enumerate(seeds)]).astype(np.int64)


def tables(digest: np.ndarray, own: np.ndarray, sign: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, digest and check sums modulo 2**64) of n tables with signed entries."""
    at = (cells_of(digest, cells) + own * cells).ravel()
    signs = np.tile(sign, HASHES)
    count = np.bincount(at, signs, minlength=n * cells).astype(np.int64)
    total = np.zeros((2, n * cells), np.uint64)
    for row, value in zip(total, (digest, check(digest))):
        np.add.at(row, at, np.tile(value, HASHES) * signs.astype(np.int64).view(np.uint64))
    return count, total


def peel(count: np.ndarray, total: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Take lone digests out of all tables until none is left: (table, digest and
    sign of what came out, tables that are empty then)."""
    count, total = count.copy(), total.copy()
    table, found, signs = [], [], []
    look = np.flatnonzero(np.abs(count) == 1)
    for _ in range(ROUNDS):
        c = count[look]
        digest, checked = np.where(c == 1, total[:, look], np.uint64(0) - total[:, look])
        good = (np.abs(c) == 1) & (checked == check(digest))
        look, digest, c = look[good], digest[good], c[good]
        good = (cells_of(digest, cells) == look % cells).any(axis=0)
        own, digest, c = look[good] // cells, digest[good], c[good]
        if not len(own):
            break
        _, one = np.unique(mix(digest + own.astype(np.uint64) * np.uint64(MIX_A)), return_index=True)
        own, digest, c = own[one], digest[one], c[one]
        table.append(own)
        found.append(digest)
        signs.append(c)
        at = (cells_of(digest, cells) + own * cells).ravel()
        c3 = np.tile(c, HASHES)
        np.subtract.at(count, at, c3)
        for row, value in zip(total, (digest, check(digest))):
            np.subtract.at(row, at, np.tile(value, HASHES) * c3.view(np.uint64))
        look = np.unique(at)
    empty = (count.reshape(n, cells) == 0).all(axis=1) & (total.reshape(2, n, cells) == 0).all(axis=(0, 2))
    join = (lambda x, t: np.concatenate(x) if x else np.zeros(0, t))
    return join(table, np.int64), join(found, np.uint64), join(signs, np.int64), empty


def exactly(digest: np.ndarray, own: np.ndarray, sign: np.ndarray, n: int) -> np.ndarray:
    """Digests in which the two sides of each of n pairs differ, as multisets."""
    order = np.lexsort((digest, own))
    digest, own, sign = digest[order], own[order], sign[order]
    first = np.ones(len(own), bool)
    first[1:] = (digest[1:] != digest[:-1]) | (own[1:] != own[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(n, np.int64)
    return np.bincount(own[start], np.abs(np.add.reduceat(sign, start)), minlength=n).astype(np.int64)


def differences(digest: np.ndarray, poff: np.ndarray, a: np.ndarray, b: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Paragraphs in which texts a[i] and b[i] differ, for all pairs at once.

    The fingerprints (count, total) are subtracted and peeled; pairs that do not
    peel are compared again with larger tables, until these have ENOUGH cells for
    each paragraph: what does not peel then never may, and is counted exactly."""
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    cells = BASE_CELLS
    many = np.diff(poff)
    c = (count[a] - count[b]).ravel()
    t = (total[:, a] - total[:, b]).reshape(2, -1)

    def entries() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for side, sign in ((a, 1), (b, -1)):
            s, e = poff[side[todo]], poff[side[todo] + 1]
            ends = np.cumsum(e - s)
            where = np.arange(int(ends[-1])) + np.repeat(s - (ends - (e - s)), e - s)
            parts.append((digest[where], np.repeat(np.arange(len(todo)), e - s), np.full(len(where), sign)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    while True:
        table, _, _, empty = peel(c, t, len(todo), cells)
        got = np.bincount(table, minlength=len(todo))
        out[todo[empty]] = got[empty]
        left = todo[~empty]
        enough = cells >= ENOUGH * (many[a[left]] + many[b[left]])
        todo = left[enough]
        if len(todo):
            out[todo] = exactly(*entries(), len(todo))
        todo = left[~enough]
        if not len(todo):
            return out
        cells *= GROWTH
        c, t = tables(*entries(), len(todo), cells)


def fingerprint_strings(count: np.ndarray, total: np.ndarray) -> list[str]:
    """Counts (32 bits), digest sums (64) and check sums (32) of the cells, in base64."""
    kinds = [(count, "<i4"), (total[0], "<u8"), (total[1], "<u4")]
    parts = [np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(count), -1) for x, kind in kinds]
    return [base64.b64encode(x.tobytes()).decode() for x in np.concatenate(parts, axis=1)]


def compare(texts: list[str], nexts: list[str]) -> list[tuple]:
    """For each text and the one after it: (n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)."""
    n = len(texts)
    edited, size = [], []
    for text, after in zip(texts, nexts):
        half = len(text) // 2
        size.append(len(text))
        edited.append((text[: len(text) - half] + after[:half]).encode())
    every = [t.encode() for t in texts] + edited + [t.encode() for t in nexts]
    raw = np.frombuffer(b"".join(every), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int64)
    digest, poff = paragraphs(raw, off)
    many = np.diff(poff)
    count, total = tables(digest, np.repeat(np.arange(3 * n), many), np.ones(len(digest), np.int64), 3 * n, BASE_CELLS)
    count, total = count.reshape(3 * n, BASE_CELLS), total.reshape(2, 3 * n, BASE_CELLS)
    first = np.tile(np.arange(n), 2)
    second = np.arange(n, 3 * n)
    apart = differences(digest, poff, first, second, count, total)
    both = many[first] + many[second]
    near = np.where(both > 0, (both - apart) / np.maximum(both, 1), 1.0)
    prints = fingerprint_strings(count[: 2 * n], total[:, : 2 * n])
    return [
        (size[i], hashlib.sha256(edited[i]).hexdigest(), prints[i], prints[n + i], float(near[i]), float(near[n + i])) for i in range(n)
    ]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike it is to
    that and to the next document's.

    The edited text: the last half of the code points (rounded down) replaced by
    the first as many of the next document by ascending id (after the last, the
    first).  Rows are dealt by id ranges and sorted, once, so a document's next is
    the next row; only the first and last document of every partition meet again
    over a join on partition numbers.  The narrow result is checkpointed between.

    A fingerprint is a table of HASHES x 4 cells (count, digest sum, check sum) that
    each paragraph enters HASHES times.  Subtracting two and peeling lone digests
    gives the differing paragraphs; where that fails, larger tables are tried, and
    at last the digests compared.  Likeness: 2 * common / (paragraphs of both), 1
    for two empty texts.

    Null texts are empty.  Null ids come first; equal ids follow a hash of the
    text.  One document alone is its own next.  Other columns are ignored; an empty
    table gives an empty result.  Columns: the id and FIELDS.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = (
        df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").withColumn("part", F.spark_partition_id())
    names = ["kind", "part", "id", "text", *NAMES]

    def batch(id_type: pa.DataType, records: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), id_type, pa.string()] + [KINDS.get(n, pa.string()) for n in NAMES]
        cols = list(zip(*records)) if records else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    nothing = (None,) * len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (id, text) in order; the last waits for its next
        size, part, id_type = 0, None, None
        for b in batches:
            for i, text, p in zip(b.column(0), b.column(1), b.column(3)):
                if part is None:
                    part, id_type = p.as_py(), b.schema.field(0).type
                    yield batch(id_type, [(1, part, i.as_py(), text.as_py(), *nothing)])
                held.append((i.as_py(), text.as_py()))
                size += len(held[-1][1])
                if size >= GROUP_BYTES and len(held) > 1:
                    got = compare([t for _, t in held[:-1]], [t for _, t in held[1:]])
                    yield batch(id_type, [(0, part, h[0], None, *g) for h, g in zip(held, got)])
                    held, size = held[-1:], len(held[-1][1])
        if held:
            got = compare([t for _, t in held[:-1]], [t for _, t in held[1:]]) if len(held) > 1 else []
            yield batch(id_type, [(0, part, h[0], None, *g) for h, g in zip(held, got)] + [(2, part, *held[-1], *nothing)])

    done = cut_lineage(dealt.mapInArrow(run, f"kind int, part int, id {kind}, text string, {FIELDS}"))
    # one row per partition: numbers only, no texts
    order = Window.orderBy("part")
    turn = done.where("kind = 1").select("part").withColumn("after", F.lead("part").over(order))
    turn = turn.withColumn("after", F.coalesce("after", F.min("part").over(Window.partitionBy(F.lit(0)))))
    lasts = done.where("kind = 2").select("part", "id", "text").join(turn, "part")
    firsts = done.where("kind = 1").select(F.col("part").alias("after"), F.col("text").alias("next"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                (got,) = compare([b.column(1)[j].as_py()], [b.column(2)[j].as_py()])
                cols = [b.column(0).slice(j, 1)] + [pa.array([v], KINDS.get(n, pa.string())) for n, v in zip(NAMES, got)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", *NAMES])

    edge = lasts.join(firsts, "after").select("id", "text", "next").mapInArrow(ends, f"id {kind}, {FIELDS}")
    return done.where("kind = 0").select("id", *NAMES).unionByName(edge).withColumnRenamed("id", id_col)
