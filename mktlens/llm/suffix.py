"""Exact repeats of at least ``length`` bytes by suffix arrays over anchored
segments.

A corpus has no suffix array that fits a task, so equal strings are brought
together first.  Every window of ``length`` bytes has an anchor: the least k-gram
hash inside it (k = length // 4, the first of equals), which depends on the
window's bytes alone.  Equal windows thus have equal anchors at equal places, and
the windows of one anchor occurrence are one run of starts, the *segment*
text[lo : hi + length].  Repeats only exist between segments of one anchor hash.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktlens.llm._arrow import MIX_A, MIX_B, RollingHash, carried, mix, slices
from mktlens.session import cut_lineage

BATCH_BYTES = 2 << 20  # of segments sorted together
MARK_BITS = 1 << 22  # of the tables that spare rows a join
HOT = 16_384  # distinct segments of an anchor that a suffix array takes; more go window by window


# --- anchors and segments ------------------------------------------------


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (block prefix and suffix minima)."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    forward = np.minimum.accumulate(y, axis=1).ravel()
    backward = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def anchors(raw: np.ndarray, off: np.ndarray, length: int, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, text, first and last window start inside the
    text) of every anchor occurrence whose hash ``keep`` takes."""
    k = length // 4
    w = length - k + 1
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    if len(raw) < length or not (np.diff(off) >= length).any():
        return nothing
    rolling = RollingHash(raw)
    g = rolling.all(k)
    if len(raw) >= 1 << 32:
        raise ValueError("a text of 4 GiB or more")
    # hash above, position below: the first of equals is the least
    least = window_least((g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64), w) & np.uint64(0xFFFFFFFF)
    size = np.maximum(np.diff(off) - length + 1, 0)
    ends = np.cumsum(size)
    start = np.arange(int(ends[-1])) + np.repeat(off[:-1] - (ends - size), size)
    at = least[start]
    turn = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    lo, hi = start[turn], start[np.append(turn[1:], len(start)) - 1]
    p = at[turn].astype(np.int64)
    h = g[p]
    if keep is not None:
        kept = keep(h)
        h, p, lo, hi = h[kept], p[kept], lo[kept], hi[kept]
    text = np.searchsorted(off, lo, side="right") - 1
    shape = (p - lo).astype(np.uint64) * np.uint64(MIX_A) + (hi - lo).astype(np.uint64)
    return h, mix(rolling.of(lo, hi + length) + shape * np.uint64(MIX_B)), text, lo - off[text], hi - off[text]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _hashes(docs: DataFrame, length: int) -> DataFrame:
    """One row per anchor hash and slice, with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, off in slices(batches, "text"):
            h, n = np.unique(anchors(raw, off, length)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(h), pa.array(n.astype(np.int32))], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n int")


def _repeated(spark: SparkSession, hashes: DataFrame, bits: int):
    """A bit table of fixed size with the anchor hashes met more than once.  A
    false positive costs a segment that stays single; nothing is lost."""
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = (
        hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
        .groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    )
    word = np.zeros(bits // 64, np.int64)
    # bits / 64 rows at most, whatever the input
    found = rows.toArrow()
    word[found["w"].to_numpy()] = found["b"].to_numpy()
    return spark.sparkContext.broadcast(word.tobytes())


def _occurrences(docs: DataFrame, length: int, bits: int, repeated, with_text: bool) -> DataFrame:
    """Occurrences of anchors that may repeat: (h, seg, id, rk, lo, hi), with the
    segment's bytes once a slice if asked for."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(repeated.value, np.uint64)

        def may_repeat(h: np.ndarray) -> np.ndarray:
            slot = h & np.uint64(bits - 1)
            return (seen[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)

        for rows, raw, off in slices(batches, "text"):
            h, seg, text, lo, hi = anchors(raw, off, length, may_repeat)
            cols = [signed(h), signed(seg), rows.column(0).take(pa.array(text)), rows.column(1).take(pa.array(text)), pa.array(lo), pa.array(hi)]
            names = ["h", "seg", "id", "rk", "lo", "hi"]
            if with_text:
                first = np.zeros(len(seg), bool)
                first[np.unique(seg, return_index=True)[1]] = True
                a, b = (off[text] + lo).tolist(), (off[text] + hi + length).tolist()
                data = raw.tobytes()
                cols.append(pa.array([data[x:y] if f else None for x, y, f in zip(a, b, first.tolist())], pa.binary()))
                names.append("bytes")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    extra = ", bytes binary" if with_text else ""
    return docs.select("id", "rk", "text").mapInArrow(run, f"h long, seg long, id {kind}, rk long, lo long, hi long{extra}")


# --- suffix arrays -------------------------------------------------------


def suffix_order(raw: np.ndarray, depth: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of the given starts, by the first ``depth`` bytes and then by
    position; rank of each of them), by prefix doubling.  Suffixes that agree in
    ``depth`` bytes share a rank.  Every start must have ``depth`` bytes."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    have = 8
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while have < depth:
        step = min(have, depth - have)
        if have + step == depth:
            pair = (rank[starts] << np.uint64(32)) | rank[starts + step]
            final = np.unique(pair, return_inverse=True)[1]
            return np.argsort(final, kind="stable"), final
        after = np.zeros(n, np.uint64)
        after[: n - step] = rank[step:]
        rank = np.unique((rank << np.uint64(32)) | after, return_inverse=True)[1].astype(np.uint64)
        have += step
    final = rank[starts].astype(np.int64)
    return np.argsort(final, kind="stable"), final


def earlier_and_other(order: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix: do its first ``depth`` bytes start at an earlier place, and at
    any other?

    Suffixes of one rank stand side by side in the suffix order, by position: one
    whose left neighbour has its rank has an earlier copy, one with either neighbour
    of its rank any.  No longest previous factors are computed: whether they reach
    the depth is all that is asked.
    """
    r = rank[order]
    same = np.concatenate([[False], r[1:] == r[:-1]])
    earlier = np.zeros(len(rank), bool)
    other = np.zeros(len(rank), bool)
    earlier[order] = same
    other[order] = same | np.append(same[1:], False)
    return earlier, other


def ranges(flag: np.ndarray, own: np.ndarray, offset: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags: (ends of the runs of each owner, first, last offset)."""
    at = np.flatnonzero(flag)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[at][1:] != own[at][:-1])]) if len(at) else np.zeros(0, bool)
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
    ends = np.concatenate([[0], np.cumsum(np.bincount(own[first], minlength=n))])
    return ends.astype(np.int32), offset[first], offset[last]


def range_lists(*cols: np.ndarray) -> pa.Array:
    ends, a, b = cols
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["a", "b"]))


SPAN = "array<struct<a:int,b:int>>"


def _by_suffix_array(groups: DataFrame, length: int) -> DataFrame:
    """Windows of the segments of each anchor that another segment of it holds
    (``other``), and that an earlier one holds (``earlier``)."""

    def solve(part: list[tuple]) -> pa.RecordBatch:
        # an anchor's segments by first occurrence, so that earlier means earlier
        part.sort(key=lambda r: (r[0], r[3] is not None, r[3], r[4], r[5]) if r[3] is not None else (r[0], False, 0, r[4], r[5]))
        raw = np.frombuffer(b"".join(r[2] for r in part), np.uint8)
        size = np.array([len(r[2]) for r in part])
        windows = size - length + 1
        own = np.repeat(np.arange(len(part)), windows)
        ends = np.cumsum(windows)
        offset = np.arange(int(ends[-1])) - np.repeat(ends - windows, windows)
        starts = (np.cumsum(size) - size)[own] + offset
        order, rank = suffix_order(raw, length, starts)
        earlier, other = earlier_and_other(order, rank)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
             range_lists(*ranges(other, own, offset, len(part))), range_lists(*ranges(earlier, own, offset, len(part)))],
            names=["h", "seg", "other", "earlier"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BATCH_BYTES and row[0] != last:
                    yield solve(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[2])
                last = row[0]
        if part:
            yield solve(part)

    dealt = groups.select("h", "seg", "bytes", "first.id", "first.rk", "first.lo").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, f"h long, seg long, other {SPAN}, earlier {SPAN}")


def _by_windows(groups: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments, whose windows are counted by
    128-bit digests: combined before the shuffle, and joined back with hot windows
    split, so that no task gathers such an anchor."""

    def digests(part: list[tuple]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(r[2] for r in part), np.uint8)
        size = np.array([len(r[2]) for r in part])
        windows = size - length + 1
        own = np.repeat(np.arange(len(part)), windows)
        d = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = (np.cumsum(size) - size)[own] + d
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[0] for r in part])[own]), pa.array(np.array([r[1] for r in part])[own]), signed(RollingHash(raw).of(start, start + length)),
             signed(RollingHash(255 - raw).of(start, start + length)), pa.array(d.astype(np.int32))],
            names=["h", "seg", "w", "v", "d"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                part.append(row)
                size += len(row[2])
                if size >= BATCH_BYTES // 4:
                    yield digests(part)
                    part, size = [], 0
        if part:
            yield digests(part)

    each = groups.select("h", "seg", "bytes").mapInArrow(run, "h long, seg long, w long, v long, d int")
    each = each.join(groups.select("h", "seg", "first"), ["h", "seg"])
    known = each.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least")).where("n > 1")
    span = F.struct(F.col("d").alias("a"), F.col("d").alias("b"))
    hit = each.join(known, ["w", "v"]).groupBy("h", "seg").agg(
        F.collect_set(span).alias("other"), F.collect_set(F.when(F.col("first") > F.col("least"), span)).alias("earlier")
    )
    return hit.select("h", "seg", "other", "earlier")


# --- the operator --------------------------------------------------------


def repeats(df: DataFrame, length: int = 200, keep_first: bool = False, bits: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text",
            with_text: bool = True, carry: str | None = None) -> DataFrame:
    """Remove the bytes of every text that are covered by a string of ``length``
    bytes which also starts elsewhere, in this text or another; strings are judged
    on the input.  With ``keep_first`` only strings with an earlier copy (by id, a
    hash of the text, and position) are removed, so the first copy of each stays.

    1. Anchor hashes are counted (a map-side combined aggregate); those met twice
       set a bit in a table of fixed size.  2. Occurrences with that bit are grouped
       by segment: a segment met twice repeats as a whole, however hot it is.
       3. Anchors with several different segments: their suffixes are sorted by their
       first ``length`` bytes, and the neighbours in that order tell which windows
       repeat (the left one: which have an earlier copy).  Anchors with over HOT segments
       are counted window by window.  4. The verdicts join the occurrences, and a
       document's spans join its text.  Hot keys of both joins are split by AQE.

    Null and empty texts have nothing to remove.  Equal rows (id and text) are
    copies of each other; with ``keep_first`` all of them count as the first.
    Null ids come first.  Other columns are ignored; an empty table gives an empty
    result.  Columns: the id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``with_text`` kept (the text without the spans, a span beginning or ending
    inside a character narrowed to whole characters; null for null), and the column
    ``carry`` as it is, if given.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    if length < 32:
        raise ValueError("strings of 32 bytes at least")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("rk", F.xxhash64("id", "text"))
    extra, more = carried(df, carry)
    whole_rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra).withColumn("rk", F.xxhash64("id", "text"))

    repeated = _repeated(spark, _hashes(docs, length), bits)
    grouped = _occurrences(docs, length, bits, repeated, True).groupBy("h", "seg")
    counts = F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")
    if keep_first:
        segments = cut_lineage(grouped.agg(F.min(F.struct("id", "rk", "lo")).alias("first"), *counts))
    else:  # which copy comes first does not matter
        nobody = F.struct(F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("rk"), F.lit(0).cast("long").alias("lo"))
        segments = cut_lineage(grouped.agg(*counts)).withColumn("first", nobody)
    per = segments.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mixed = _marked(segments, "h", per).where("_has").drop("_has").join(per, "h")
    verdicts = _by_suffix_array(mixed.where(F.col("m") <= HOT), length).unionByName(_by_windows(mixed.where(F.col("m") > HOT), length))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("wide").alias("b")))
    narrow = segments.select("h", "seg", "first", "n", (F.octet_length("bytes") - length).alias("wide"))
    judged = narrow.join(verdicts, ["h", "seg"], "left").select(
        "h", "seg", "first", "earlier", F.when(F.col("n") > 1, whole).otherwise(F.col("other")).alias("other")
    ).where("size(other) > 0")
    # stored, so that both sides of the next join are dealt anew and a hot segment split
    judged = cut_lineage(judged)

    place = _occurrences(docs, length, bits, repeated, False).join(judged, ["h", "seg"])
    if keep_first:
        found = F.when(F.struct("id", "rk", "lo").eqNullSafe(F.col("first")), F.col("earlier")).otherwise(F.col("other"))
    else:
        found = F.col("other")
    spans = (
        place.select("id", "rk", "lo", F.explode(found).alias("w"))
        .groupBy("id", "rk").agg(F.collect_list(F.struct((F.col("lo") + F.col("w.a")).alias("a"), (F.col("lo") + F.col("w.b") + length).alias("b"))).alias("spans"))
        .withColumnsRenamed({"id": "_id", "rk": "_rk"})
    )
    spans = cut_lineage(spans)
    # documents without spans are done at once; only the others meet theirs in a join
    marked = _marked(whole_rows, "rk", spans.withColumnsRenamed({"_rk": "rk"}))
    has = F.col("_has")
    text = F.coalesce("text", F.lit(""))
    carry_out = ["_carry"] * bool(carry)
    clean = marked.where(~has).select(
        "id", *carry_out, F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"), *[F.col("text").alias("kept")] * with_text,
    )
    joined = marked.where(has).join(spans, (F.col("rk") == F.col("_rk")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    cut = joined.select("id", "text", "spans", *carry_out).mapInArrow(
        lambda batches: _cut(batches, with_text), f"id {kind}, {more}n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    )
    return clean.unionByName(cut).withColumnsRenamed({"id": id_col, "_carry": carry or "_carry"})


def _marked(rows: DataFrame, key: str, among: DataFrame) -> DataFrame:
    """``rows`` with ``_has``: may their ``key`` (a hash) be one of those of
    ``among``?  Told by a bit table of fixed size, so a bounded broadcast; a false
    positive just goes the longer way."""
    word = F.shiftright(F.col(key).bitwiseAND(F.lit(MARK_BITS - 1)), 6).alias("_w")
    words = among.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias("_bits"))
    has = F.coalesce(F.expr(f"(shiftright(_bits, cast({key} & 63 as int)) & 1) = 1"), F.lit(False))
    return rows.withColumn("_w", word).join(F.broadcast(words), "_w", "left").withColumn("_has", has).drop("_w", "_bits")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of sorted spans."""
    runs: list[list[int]] = []
    for a, b in spans:
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def without(data: bytes, runs: list[list[int]], characters: bool = False) -> bytes:
    """The bytes outside the runs; with ``characters``, runs are narrowed to whole
    UTF-8 characters first."""
    out, at = [], 0
    for a, b in runs:
        if characters:
            while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column(1), b.column(2)):
            text = text.as_py()
            data = (text or "").encode()
            runs = merged(sorted((s["a"], s["b"]) for s in spans.as_py())) if spans.is_valid else []
            kept = without(data, runs)
            row = [len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()]
            if with_text:
                row.append(None if text is None else without(data, runs, True).decode() if runs else text)
            rows.append(row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 5 if with_text else 4]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds))], names=["id", *["_carry"] * (b.num_columns - 3), *names])
