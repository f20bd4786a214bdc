"""Benchmark decontamination by winnowed word fingerprints."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktlens.llm._arrow import BASE, MIX_A, RollingHash, carried, mix, slices
from mktlens.session import cut_lineage

#: Bytes of words: digits, letters (A-Z lower-cased) and all of non-ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = True
IS_WORD[ord("a") : ord("z") + 1] = True
IS_WORD[128:] = True

WINDOWS = "array<struct<n:int,at:int,fp:long,digest:long,slot:int>>"


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets of each text in them)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    low = LOWER[raw]
    word = IS_WORD[low]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return RollingHash(low).firm(start, end), np.searchsorted(start, off)


def grams(h: np.ndarray, at: np.ndarray, k: int, factor: int) -> np.ndarray:
    """Order-sensitive hash of the k words from each position."""
    out = h[at].copy()
    for j in range(1, k):
        out *= np.uint64(factor | 1)
        out += h[at + j]
    return mix(out)


def winnow(h: np.ndarray, woff: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of every window of n words inside a text.

    The fingerprint is the least hash of the window's k-grams (the first of
    equals), so it depends on the window's words alone: every shared span of n
    words or more has a fingerprint in common."""
    k = min(k, n)
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, np.arange(len(h) - k + 1), k, BASE)
    least = np.lib.stride_tricks.sliding_window_view(g, n - k + 1).min(axis=1)
    ends = np.repeat(woff[1:], np.diff(woff))
    start = np.flatnonzero(np.arange(len(h)) + n <= ends)
    return start, least[start]


def _windows(df: DataFrame, id_name: str, lengths: list[int] | None, longest: int, k: int, bits: int, filters, carry: str | None = None) -> DataFrame:
    """Per row: its number of words and its windows.  ``lengths`` None: a row's own
    window length (items); else windows of these lengths whose fingerprint may be
    among those of ``filters`` (a bit per slot)."""
    kind = df.schema[id_name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None if filters is None else np.frombuffer(filters.value, np.uint64)
        for rows, raw, off in slices(batches, "text"):
            h, woff = word_hashes(raw, off)
            count = np.diff(woff)
            found = []
            for n in range(1, longest + 1) if lengths is None else lengths:
                if lengths is None and not (count >= n if n == longest else count == n).any():
                    continue
                start, fp = winnow(h, woff, n, k)
                row = np.searchsorted(woff, start, side="right") - 1
                if lengths is None:
                    keep = count[row] >= n if n == longest else count[row] == n
                    start, fp, row = start[keep], fp[keep], row[keep]
                slot = mix(fp + np.uint64(n)) & np.uint64(bits - 1)
                if seen is not None:
                    keep = (seen[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                    start, fp, row, slot = start[keep], fp[keep], row[keep], slot[keep]
                found.append((row, np.full(len(row), n), start - woff[row], fp, grams(h, start, n, MIX_A), slot))
            row, n, at, fp, digest, slot = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [[]] * 6))
            order = np.argsort(row, kind="stable")
            items = pa.StructArray.from_arrays(
                [pa.array(n[order], pa.int32()), pa.array(at[order], pa.int32()), pa.array(fp[order].astype(np.uint64).view(np.int64)),
                 pa.array(digest[order].astype(np.uint64).view(np.int64)), pa.array(slot[order].astype(np.int32))],
                names=["n", "at", "fp", "digest", "slot"],
            )
            ends = np.concatenate([[0], np.cumsum(np.bincount(row.astype(np.int64), minlength=len(count)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *rows.columns[2:], pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), items)],
                names=["id", *["_carry"] * bool(carry), "n_words", "windows"],
            )

    extra, more = carried(df, carry)
    return df.select(F.col(id_name).alias("id"), "text", *extra).mapInArrow(run, f"id {kind}, {more}n_words long, windows {WINDOWS}")


def _filter(spark: SparkSession, items: DataFrame, bits: int):
    """(window lengths present, one bit per slot of the items' fingerprints), of
    fixed size whatever the number of items."""
    rows = items.groupBy("n", F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("b"))
    word = np.zeros(bits // 64, np.int64)
    lengths: set[int] = set()
    # one row per length and 64 slots at most: bounded by the parameters
    for part in rows.select("n", "w", "b").toArrow().to_batches():
        lengths |= set(part.column(0).to_pylist())
        np.bitwise_or.at(word, part.column(1).to_numpy(), part.column(2).to_numpy())
    return sorted(lengths), spark.sparkContext.broadcast(word.tobytes())


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 13, k: int = 5, share: int = 20, bits: int = 1 << 22,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  carry: str | None = None) -> DataFrame:
    """Which documents hold windows of benchmark items, and how many of their words.

    A window is ``n`` consecutive words of an item (a shorter item is one window).
    Both sides are winnowed: a window's fingerprint is its least k-gram hash, so a
    shared window always has a shared fingerprint, and a run of windows few of
    them.  Documents keep the windows whose fingerprint may be an item's (a bit
    table of ``bits`` bits, fixed size; false positives only cost time), these
    join the items' windows on fingerprint and digest of all the words, and the
    hits extend each other: a document word inside any of them is hit.

    A document is contaminated if n_hit > 0 and share * n_hit >= n_words.  Null and
    empty texts have no words and no hits; empty items match nothing; repeated
    documents each give a row; repeated items and item ids count once; an item
    without id hits but is not listed.  Either table may be empty.  The items'
    windows are one row per distinct window with its items; a hot window is split
    on the document side of the join.  Other columns are ignored.  Columns: the
    id, n_words, n_hit, n_items, items (array of ids as strings), items_sha256,
    contaminated, and the column ``carry`` as it is, if given.
    """
    spark = documents.sparkSession
    test = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).cast("string").alias("text"))
    item_rows = cut_lineage(_windows(test, "id", None, n, k, bits, None).select("id", F.explode("windows").alias("w")).select("id", "w.*"))
    lengths, filters = _filter(spark, item_rows, bits)
    items = item_rows.groupBy("n", "fp", "digest").agg(F.collect_set("id").alias("items"))

    extra, _ = carried(documents, carry)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra)
    # one narrow row per document, with its candidate windows only; the row key is
    # fixed by the checkpoint, so equal ids stay apart
    base = cut_lineage(_windows(docs, "id", lengths, n, k, bits, filters, "_carry" if carry else None).withColumn("_row", F.monotonically_increasing_id()))
    found = (
        base.select("_row", F.explode("windows").alias("w")).select("_row", "w.n", "w.at", "w.fp", "w.digest")
        .join(items, ["n", "fp", "digest"])
    )
    spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to"))))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("sum"))

    def add(acc, x):
        return F.struct(
            F.greatest(acc["to"], x["to"]).alias("to"),
            (acc["sum"] + F.greatest(x["to"] - F.greatest(acc["to"], x["at"]), F.lit(0))).alias("sum"),
        )

    hits = found.groupBy("_row").agg(
        F.aggregate(spans, zero, add, lambda a: a["sum"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    out = base.drop("windows").join(hits, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), *[F.col("_carry").alias(carry or "_carry")] * bool(carry),
    )
