"""Substring dedup by repeated-phrase automata: recurring passages of words are
confirmed, compiled into sharded Aho-Corasick automata, and located in all texts."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktlens.llm._arrow import BASE, MIX_A, RollingHash, carried, mix, slices
from mktlens.llm.decontamination import grams
from mktlens.llm.suffix import _marked, merged
from mktlens.session import cut_lineage

#: Windows of one container at most: a periodic text is cut into many.
RUN = 64
#: Bytes of passages that one automaton is compiled from (a group of equal keys more):
#: its nodes search their children one by one, and its root has one for every passage.
SHARD_BYTES = 64 << 10

IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_table(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash of every word, offsets of each text in them)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = ~IS_GAP[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, RollingHash(raw).firm(start, end), np.searchsorted(start, off)


def containers(h: np.ndarray, woff: np.ndarray, n: int, k: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of the containers that hold every
    window of ``n`` words.

    A window's anchor is its least k-gram hash, so equal windows have equal anchors
    wherever they stand.  Neighbouring windows of one anchor share a container, but
    for ``hot`` anchors (sorted), whose windows stand alone."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, np.arange(len(h) - k + 1), k, BASE)
    least = g[:m].copy()
    for j in range(1, n - k + 1):
        np.minimum(least, g[j : j + m], out=least)
    start = np.flatnonzero(np.arange(m) + n <= np.repeat(woff[1:], np.diff(woff))[:m])
    if len(start) == 0:
        return start, start, np.zeros(0, np.uint64)
    least = least[start]
    edge = np.zeros(len(h) + 1, bool)
    edge[woff] = True
    head = edge[start]
    head[0] = True
    head[1:] |= (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
        head |= hot[at] == least
    first = np.flatnonzero(head)
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    first = np.flatnonzero(head | (place % RUN == 0))
    return start[first], np.diff(np.append(first, len(start))), least[first]


def _anchors(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(g, id): the anchors of every text."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in slices(batches, "text"):
            _, _, h, woff = word_table(raw, off)
            first, _, g = containers(h, woff, n, k, np.zeros(0, np.uint64))
            row = np.searchsorted(woff, first, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), rows.column(0).take(pa.array(row))], names=["g", "id"])

    return docs.select("id", "text").mapInArrow(run, f"g long, id {kind}")


def _recurring(spark: SparkSession, anchors: DataFrame, bits: int, hot: int):
    """(a bit for every anchor of two documents, sorted hot anchors), both of bounded
    size whatever the input: the first by ``bits``, the second as only anchors with
    over a 100,000th of all occurrences, and over ``hot``, count as hot."""
    counts = cut_lineage(anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("g", "n"))
    words = counts.groupBy(F.shiftright(F.col("g").bitwiseAND(F.lit(bits - 1)), 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(g & 63 as int))")).alias("b"))
    table = np.zeros(bits // 64, np.int64)
    for part in words.toArrow().to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy()
    total = counts.agg(F.sum("n")).first()[0] or 0
    many = counts.where(F.col("n") > max(hot, total // 100_000)).select("g").toArrow().column(0)
    return spark.sparkContext.broadcast((table.tobytes(), np.sort(np.array(many.to_pylist(), np.int64).view(np.uint64)).tobytes()))


def _containers(docs: DataFrame, n: int, k: int, bits: int, recurring, whole: bool) -> DataFrame:
    """Containers whose anchor may recur, with their digest ``sd``: (g, sub, sd,
    bytes, least, most) if ``whole``, equal ones of a slice combined; else where they
    stand: (id, rk, lo, sd).  ``sub`` tells the windows of a hot anchor apart."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot = (np.frombuffer(x, np.uint64) for x in recurring.value)
        for rows, raw, off in slices(batches, "text"):
            start, end, h, woff = word_table(raw, off)
            first, size, g = containers(h, woff, n, k, hot)
            keep = (table[(g & np.uint64(bits - 1)) >> np.uint64(6)] >> (g & np.uint64(63)) & np.uint64(1)).astype(bool)
            first, size, g = first[keep], size[keep], g[keep]
            row = pa.array(np.searchsorted(woff, first, side="right") - 1)
            data = raw.tobytes()
            text = [b" ".join(data[a:b].split()) for a, b in zip(start[first].tolist(), end[first + size + n - 2].tolist())]
            sd = [xxhash.xxh3_128_digest(x) for x in text]
            if whole:
                seen: dict[bytes, list] = {}
                for i, (x, d) in enumerate(zip(sd, rows.column(0).take(row).to_pylist())):
                    old = seen.setdefault(x, [i, d, d])
                    if d < old[1]:
                        old[1] = d
                    elif d > old[2]:
                        old[2] = d
                own = np.array([x[0] for x in seen.values()], np.int64)
                text, g = [text[i] for i in own.tolist()], g[own]
                sub = np.zeros(len(g), np.int64)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g
                    sub[is_hot] = [xxhash.xxh3_64_intdigest(text[i]) >> 1 for i in np.flatnonzero(is_hot).tolist()]
                ids = (pa.array([x[j] for x in seen.values()], rows.column(0).type) for j in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(sub), pa.array(seen.keys(), pa.binary()), pa.array(text, pa.binary()), *ids],
                    names=["g", "sub", "sd", "bytes", "least", "most"],
                )
            else:
                lo = first - woff[row.to_numpy()]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(row), rows.column(2).take(row), pa.array(lo), pa.array(sd, pa.binary())], names=["id", "rk", "lo", "sd"])

    return docs.select("id", "text", "rk").mapInArrow(run, f"g long, sub long, sd binary, bytes binary, least {kind}, most {kind}" if whole else f"id {kind}, rk long, lo long, sd binary")


def located(passages: list[bytes], least: list, most: list, n: int) -> list[list[tuple[int, int, object]]]:
    """For each passage its windows of ``n`` words that lie in two documents, as runs
    (first window, last window, least document id); ``least`` and ``most`` are the ids
    of the documents that hold a passage.

    Confirms the recurring windows word by word, compiles them into an Aho-Corasick
    automaton over word numbers (windows that no other passage has, run by run), and
    streams the passages through it."""
    import ahocorasick

    number: dict[bytes, int] = {}
    size = np.array([p.count(b" ") + 1 for p in passages])
    # 0 stands between passages, and is in no pattern
    ids = np.zeros(int(size.sum()) + len(passages), np.int64)
    at = np.cumsum(size + 1) - (size + 1)
    inner = np.ones(len(ids), bool)
    inner[at + size] = False
    ids[inner] = [number.setdefault(w, len(number) + 1) for w in b" ".join(passages).split(b" ")]
    windows = size - n + 1
    own = np.repeat(np.arange(len(passages)), windows)
    start = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows) + at[own]
    names = sorted({*least, *most})
    order = {x: i for i, x in enumerate(names)}
    lo, hi = (np.array([order[x] for x in ids_])[own] for ids_ in (least, most))

    digest = grams(mix(ids.astype(np.uint64) * np.uint64(MIX_A)), start, n, BASE)
    words = np.lib.stride_tricks.sliding_window_view(ids, n)[start]
    same = np.argsort(digest, kind="stable")
    equal = digest[same[1:]] == digest[same[:-1]]
    pairs = np.flatnonzero(equal)
    if (words[same[pairs + 1]] != words[same[pairs]]).any():  # two windows of one digest
        same = np.lexsort(words.T)
        equal = (words[same[1:]] == words[same[:-1]]).all(axis=1)
    first = np.flatnonzero(np.concatenate([[True], ~equal]))
    lowest, highest = np.minimum.reduceat(lo[same], first), np.maximum.reduceat(hi[same], first)
    number_of = np.diff(np.append(first, len(same)))
    recurs = lowest != highest
    found: list[list[tuple[int, int, object]]] = [[] for _ in passages]
    if not recurs.any():
        return found

    shared = np.flatnonzero(recurs & (number_of > 1))
    begin, end, value = start[same[first[shared]]], start[same[first[shared]]] + n, lowest[shared]
    alone = np.zeros(len(start), bool)
    alone[same[first[recurs & (number_of == 1)]]] = True
    head = alone & ~np.concatenate([[False], alone[:-1] & (own[1:] == own[:-1])])
    tail = alone & ~np.concatenate([alone[1:] & (own[1:] == own[:-1]), [False]])
    begin, end, value = np.append(begin, start[head]), np.append(end, start[tail] + n), np.append(value, lo[head])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    text = tuple(ids.tolist())
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
        automaton.add_word(text[a:b], i)
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
    to = hits[:, 0] - n + 1
    since = hits[:, 0] + 1 - (end - begin)[hits[:, 1]]
    owner = np.searchsorted(at, since, side="right") - 1
    for o, a, b, v in zip(owner.tolist(), (since - at[owner]).tolist(), (to - at[owner]).tolist(), value[hits[:, 1]].tolist()):
        found[o].append((a, b, names[v]))
    return found


def _locate(groups: DataFrame, n: int, shard_bytes: int) -> DataFrame:
    """(sd, windows): the recurring windows of every container."""
    kind = groups.schema["least"].dataType.simpleString()

    def solve(part: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        found = located([r[3] for r in part], [r[4] for r in part], [r[5] for r in part], n)
        keep = [i for i, f in enumerate(found) if f]
        ends = np.concatenate([[0], np.cumsum([len(found[i]) for i in keep])]).astype(np.int32)
        flat = [x for i in keep for x in found[i]]
        items = pa.StructArray.from_arrays([*[pa.array([x[j] for x in flat], pa.int32()) for j in (0, 1)], pa.array([x[2] for x in flat], id_type)], names=["a", "b", "least"])
        return pa.RecordBatch.from_arrays([pa.array([part[i][2] for i in keep], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["sd", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size, last, id_type = 0, None, None
        for b in batches:
            id_type = b.schema.field("least").type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if part and row[2] == part[-1][2]:
                    old = part[-1]
                    part[-1] = (*old[:4], min(old[4], row[4]), max(old[5], row[5]))
                    continue
                if size >= shard_bytes and row[:2] != last:
                    yield solve(part, id_type)
                    part, size = [], 0
                part.append(row)
                size += len(row[3])
                last = row[:2]
        if part:
            yield solve(part, id_type)

    dealt = groups.select("g", "sub", "sd", "bytes", "least", "most").repartition("g", "sub").sortWithinPartitions("g", "sub", "sd")
    return dealt.mapInArrow(run, f"sd binary, windows array<struct<a:int,b:int,least:{kind}>>")


def remove_repeats(df: DataFrame, n: int = 13, k: int = 5, bits: int = 1 << 25, hot: int = 1000, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = True, carry: str | None = None) -> DataFrame:
    """Remove every word that is covered by ``n`` consecutive words which also stand
    in a document with a smaller id; windows are judged on the input.  Words are runs
    without space, tab, line feed, vertical tab, form feed and carriage return.

    1. Every window has an anchor, its least k-gram; anchors of two documents set a
    bit in a table of fixed size.  2. Neighbouring windows of such an anchor are one
    container (the windows of a hot anchor stand alone); equal containers of a slice
    are combined before the shuffle, so a passage of all documents is a row per slice.
    3. Containers are dealt by anchor; each shard confirms the windows that lie in two
    documents, compiles them into an Aho-Corasick automaton, and streams its containers
    through it.  4. The occurrences of containers in all documents meet the located
    windows, and documents their spans; hot keys of both joins are split by AQE.

    Null and empty texts have no words.  A row with a null id keeps all words and is no
    earlier copy; rows of equal id are not copies of each other.  Repeated rows each
    give a row.  Other columns are ignored; an empty table gives an empty result.
    Columns: the id, n_words, n_removed, kept_sha256, with ``with_text`` kept (the words
    that stay, joined by one space; null for null), and the column ``carry`` as it is,
    if given.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    if not 1 <= k <= n:
        raise ValueError("k-grams of 1 to n words")
    extra, more = carried(df, carry)
    whole = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra).withColumn("rk", F.xxhash64("id", "text"))
    docs = whole.select("id", "text", "rk").where("id is not null")

    recurring = _recurring(spark, _anchors(docs, n, k), bits, hot)
    # stored, so that both sides of the next join are dealt anew and a hot container split
    windows = cut_lineage(_locate(_containers(docs, n, k, bits, recurring, True), n, shard_bytes))
    place = _containers(docs, n, k, bits, recurring, False).join(windows, "sd")
    later = F.filter("windows", lambda w: w["least"] < F.col("id"))
    # the windows of a container overlap, but for those of a periodic text
    low, high = F.array_min(F.transform("later", lambda w: w["a"])), F.array_max(F.transform("later", lambda w: w["b"]))
    one = F.array(F.struct((F.col("lo") + low).alias("a"), (F.col("lo") + high + n).alias("b")))
    each = F.transform("later", lambda w: F.struct((F.col("lo") + w["a"]).alias("a"), (F.col("lo") + w["b"] + n).alias("b")))
    spans = (
        place.select("id", "rk", "lo", later.alias("later")).where("size(later) > 0")
        .select("id", "rk", F.explode(F.when(high - low < n, one).otherwise(each)).alias("span"))
        .groupBy("id", "rk").agg(F.collect_list("span").alias("spans")).withColumnsRenamed({"id": "_id", "rk": "_rk"})
    )
    spans = cut_lineage(spans)
    marked = _marked(whole, "rk", spans.withColumnsRenamed({"_rk": "rk"}))
    has = F.col("_has")
    carry_out = ["_carry"] * bool(carry)
    clean = marked.where(~has).select("id", "text", F.array().cast("array<struct<a:long,b:long>>").alias("spans"), *carry_out)
    joined = marked.where(has).join(spans, (F.col("rk") == F.col("_rk")) & (F.col("id") == F.col("_id")), "left").select("id", "text", "spans", *carry_out)
    out = clean.unionByName(joined).mapInArrow(
        lambda batches: _kept(batches, with_text), f"id {kind}, {more}n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    )
    return out.withColumnsRenamed({"id": id_col, "_carry": carry or "_carry"})


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column(1), b.column(2)):
            text = text.as_py()
            words = (text or "").encode().split()
            kept, at = [], 0
            for a, e in merged(sorted((x["a"], x["b"]) for x in spans.as_py())) if spans.is_valid else []:
                kept += words[at:a]
                at = e
            data = b" ".join(kept + words[at:])
            row = [len(words), len(words) - len(kept) - len(words[at:]), hashlib.sha256(data).hexdigest()]
            rows.append([*row, None if text is None else data.decode()] if with_text else row)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 if with_text else 3]
        names = ["n_words", "n_removed", "kept_sha256", "kept"][: len(kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds))], names=["id", *["_carry"] * (b.num_columns - 3), *names])
