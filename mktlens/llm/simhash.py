"""SimHash near-duplicates: fingerprints and a binary trie self-join."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.llm._arrow import carried, slices
from mktlens.llm._graph import components
from mktlens.session import cut_lineage

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BLOCKS = 4  # of 16 bits, each cut again into BLOCKS of the other 48 bits
FRONTIER = 1 << 20  # node pairs that are expanded at once
LANES = np.uint64(0x0001000100010001)


# --- fingerprints --------------------------------------------------------


def shingles(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes with one space between words, start and end of every
    shingle in them, number of shingles of each text)."""
    n = len(raw)
    gap = IS_GAP[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | edge[1:n]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1] & ~edge[1:n]  # the first white space after a word
    text = LOWER[raw]
    text[gap] = 0x20
    place = np.cumsum(keep) - 1
    text = text[keep]
    start = place[begin]
    woff = np.searchsorted(np.flatnonzero(begin), off)
    stop = ~gap
    stop[:-1] &= gap[1:] | edge[1:n]
    end = place[stop] + 1
    count = np.diff(woff)
    per = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    first = np.repeat(woff[:-1] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    last = np.minimum(first + words, np.repeat(woff[1:], per)) - 1
    return text.tobytes(), start[first], end[last], per


def majority(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Bit by bit: set in over half of each text's hashes (no hash: zero)."""
    out = np.zeros(len(per), np.uint64)
    full = np.flatnonzero(per)
    if not len(full):
        return out
    first = (np.cumsum(per) - per)[full]
    # 16-bit counters, four to a word: no run of more than 65535 hashes
    cuts = np.unique(np.concatenate([first, np.arange(0, len(h), 65535)]))
    back = np.searchsorted(cuts, first)
    size = per[full]
    bits = np.zeros(len(full), np.uint64)
    for b in range(16):
        lanes = np.add.reduceat((h >> np.uint64(b)) & LANES, cuts)
        for lane in range(4):
            counts = np.add.reduceat((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF), back).astype(np.int64)
            bits |= (2 * counts > size).astype(np.uint64) << np.uint64(b + 16 * lane)
    out[full] = bits
    return out


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """(id, fp long) of every row: SimHash over the XXH64 of its word shingles,
    repeats included.  Null, empty and blank texts: zero."""
    import xxhash

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for rows, raw, off in slices(batches, "text"):
            if len(raw):
                text, start, end, per = shingles(raw, off, words)
                h = np.fromiter((digest(text[a:b], 42) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))
                fp = majority(h, per)
            else:
                fp = np.zeros(rows.num_rows, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *rows.columns[2:], pa.array(fp.view(np.int64))], names=["id", *["_carry"] * bool(carry), "fp"]
            )

    extra, more = carried(df, carry)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra).mapInArrow(run, f"id {kind}, {more}fp long")


# --- trie self-join ------------------------------------------------------


def trie_links(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join all fingerprints of a group within ``distance``
    bits into the same classes as all such pairs would.

    ``group`` and ``fp`` are sorted by (group, fp), so a trie node is a range.
    Node pairs are walked down together, bit by bit from the highest; a pair whose
    paths differ in more than ``distance`` bits is dropped, as is a pair whose
    leaves all are in one class already.  At most FRONTIER pairs are expanded at
    once, the deepest first, so memory is bounded; each class of m leaves gives at
    most m - 1 links.
    """
    n = len(fp)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(edge[1:], n)
    wide = ends - edge > 1
    root = np.arange(n)
    turns = np.arange(n)  # of class, along the leaves

    def settle() -> None:
        nonlocal root, turns
        while not np.array_equal(up := root[root], root):
            root = up
        turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])

    def find(i: int) -> int:
        while root[i] != i:
            i = int(root[i])
        return i

    left: list[int] = []
    right: list[int] = []
    a, b = edge[wide], ends[wide]
    stack = [(63, a, b, a, b, np.zeros(len(a), np.int8))]
    zeros: dict[int, np.ndarray] = {}  # of the last bit used
    while stack:
        bit, lo1, hi1, lo2, hi2, d = stack.pop()
        if len(lo1) > FRONTIER:
            for i in range(0, len(lo1), FRONTIER):
                stack.append((bit, *(x[i : i + FRONTIER] for x in (lo1, hi1, lo2, hi2, d))))
            continue
        # pairs of which all leaves are in one class can add nothing
        same = (root[lo1] == root[lo2]) & (turns[lo1] == turns[hi1 - 1]) & (turns[lo2] == turns[hi2 - 1])
        same &= (lo1 != lo2) | (hi1 - lo1 > 1)
        lo1, hi1, lo2, hi2, d = (x[~same] for x in (lo1, hi1, lo2, hi2, d))
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if bit < 0:
            leaf = np.ones(len(lo1), bool)
        x, y = lo1[leaf], lo2[leaf]
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= distance) & (root[x] != root[y])
        for i, j in zip(x[near].tolist(), y[near].tolist()):
            ri, rj = find(i), find(j)
            if ri != rj:
                root[max(ri, rj)] = min(ri, rj)
                left.append(i)
                right.append(j)
        if near.any():
            settle()
        if leaf.all():
            continue
        lo1, hi1, lo2, hi2, d = (v[~leaf] for v in (lo1, hi1, lo2, hi2, d))
        if bit not in zeros:
            zeros = {bit: np.concatenate([[0], np.cumsum((fp >> np.uint64(bit) & np.uint64(1)) == 0)])}
        z = zeros[bit]
        m1, m2 = lo1 + z[hi1] - z[lo1], lo2 + z[hi2] - z[lo2]
        twin = (lo1 == lo2) & (hi1 == hi2)
        parts = [(lo1, m1, lo2, m2, d), (m1, hi1, m2, hi2, d), (lo1, m1, m2, hi2, d + 1)]
        other = ~twin
        parts.append((m1[other], hi1[other], lo2[other], m2[other], d[other] + 1))
        new = [np.concatenate(v) for v in zip(*parts)]
        ok = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= distance)
        ok &= ~((new[0] == new[2]) & (new[1] - new[0] == 1) & (new[3] - new[2] == 1))
        new = [v[ok] for v in new]
        if len(new[0]):
            stack.append((bit - 1, *new))
    return np.array(left, np.int64), np.array(right, np.int64)


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within
    ``distance`` bits (fewer than BLOCKS).

    By the pigeonhole principle such a pair agrees in one of four 16-bit blocks,
    and outside it in one of four 12-bit blocks: sixteen 28-bit keys a fingerprint
    (narrow rows, linear in the number of distinct fingerprints).  Each key's
    fingerprints are sorted by Spark and joined in a trie of their own."""
    if distance >= BLOCKS:
        raise ValueError(f"at most {BLOCKS - 1} bits")

    def part(value, low: int, width: int):
        return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for i in range(BLOCKS):
        block = part(F.col("fp"), 16 * i, 16)
        # the other 48 bits side by side
        above = F.shiftrightunsigned(F.col("fp"), 16 * (i + 1)) if i < BLOCKS - 1 else F.lit(0).cast("long")
        below = part(F.col("fp"), 0, 16 * i) if i else F.lit(0).cast("long")
        rest = F.shiftleft(above, 16 * i).bitwiseOR(below)
        for j in range(BLOCKS):
            keys.append(F.lit((i * BLOCKS + j) << 28).cast("long") + F.shiftleft(block, 12) + part(rest, 12 * j, 12))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.uint64)

        def joined(part: np.ndarray) -> pa.RecordBatch:
            fp, key = part
            twice = np.zeros(len(key), bool)
            same = key[1:] == key[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            fp, key = fp[twice], key[twice]
            # unsigned order within a key, as the trie has it
            order = np.lexsort((fp, key))
            fp, key = fp[order], key[order]
            x, y = trie_links(key, fp, distance) if len(fp) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[y].view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in (0, 1)])
            held = np.concatenate([held, new], axis=1)
            if held.shape[1] >= 200_000:
                cut = int(np.searchsorted(held[1], held[1, -1]))  # the last key may go on
                if cut:
                    yield joined(held[:, :cut])
                    held = held[:, cut:]
        if held.shape[1]:
            yield joined(held)

    return keyed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, with_root: bool = False) -> DataFrame:
    """Class of near-duplicates of every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked, and
    classes are what links reach; the class id is its least id (null ids only
    count where a class has no other).  Equal fingerprints, however many, are one
    node: links and classes are found over distinct fingerprints.  Fingerprints
    are computed once and checkpointed (two numbers a row).

    Null, empty and blank texts have the fingerprint zero and are linked like any
    other.  Repeated rows each give a row.  Other columns are ignored; an empty
    table gives an empty result.  Columns: the id, fingerprint (16 hex digits),
    component_id, fp (the same as a long), and the column ``carry`` as it is, if
    given; with ``with_root`` also root, a fingerprint of the class (a long), which is
    the key of the class whatever its ids are.
    """
    base = cut_lineage(fingerprints(df, words, id_col, text_col, carry))
    nodes = base.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("fp"), distance)).withColumnsRenamed({"node": "fp"})
    classed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = classed.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    return base.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp", *["root"] * with_root,
        *[F.col("_carry").alias(carry or "_carry")] * bool(carry),
    )
