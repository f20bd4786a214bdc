"""Phrase collocation mining by dynamic itemset counting: lengths are interleaved in
cyclic scans of the corpus's shards."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktlens.llm._arrow import BASE, MIX_A, RollingHash, mix, slices
from mktlens.llm.suffix import _marked
from mktlens.session import cut_lineage, ensure_checkpoint_dir

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Tasks that the phrases of one language are joined in.
SALTS = 64
#: Bytes of text that a task counts at a time.
COUNT_BYTES = 4 << 20
#: Bytes of phrases that a task hands to Spark at a time.
HANDED_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[[0x20, 0x09]] = True

ROWS = "lang string, k int, phrase string, n long"


def pieces(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of every word, words of its piece from it on, its text)."""
    n = len(low)
    word = ~IS_GAP[low]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    stop[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if len(start) == 0:
        return start, end, start, start
    text = np.searchsorted(off, start, side="right") - 1
    breaks = np.cumsum(IS_BREAK[low])
    head = np.ones(len(start), bool)
    head[1:] = (text[1:] != text[:-1]) | (breaks[start[1:]] != breaks[end[:-1] - 1])
    first = np.append(np.flatnonzero(head), len(start))
    return start, end, np.repeat(first[1:], np.diff(first)) - np.arange(len(start)), text


def numbered(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of words; equal numbers are equal words."""
    size = end - start
    inner = np.zeros(len(low) + 1, np.int8)
    inner[start] += 1
    inner[end] -= 1
    data = low[np.cumsum(inner[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), seed=1)


def phrase_keys(langs: list[str], phrases: list[bytes]) -> np.ndarray:
    """The keys of phrases (words joined by a space) in the activation table."""
    low = np.frombuffer(b" ".join(phrases), np.uint8)
    stop = np.append(np.flatnonzero(low == 0x20), len(low))
    start = np.concatenate([[0], stop[:-1] + 1])
    h = RollingHash(low).firm(start, stop)
    size = np.array([p.count(b" ") + 1 for p in phrases])
    first = np.cumsum(size) - size
    g = np.array([lang_hash(x) for x in langs], np.uint64)
    for k in range(int(size.max())):
        more = np.flatnonzero(size > k)
        g[more] = g[more] * np.uint64(BASE) + h[first[more] + k]
    return mix(g * np.uint64(MIX_A))


def _isin(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key & np.uint64(len(table) * 64 - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _joined(low: np.ndarray, gaps: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The phrases from ``start`` to ``end`` as strings, words joined by one space.
    ``gaps``: how many bytes before a place keep a phrase from being a copy of its
    bytes (a tab, or a space after another gap)."""
    size = end - start
    odd = np.flatnonzero(gaps[end] != gaps[start])
    at = np.cumsum(size) - size
    data = low[np.repeat(start - at, size) + np.arange(int(size.sum()))]
    offsets = np.append(at, len(data))
    out = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    if not len(odd):
        return out
    words = [b" ".join(low[a:b].tobytes().split()).decode() for a, b in zip(start[odd].tolist(), end[odd].tolist())]
    chosen = np.arange(len(start))
    chosen[odd] = len(start) + np.arange(len(odd))
    return pa.concat_arrays([out, pa.array(words, pa.large_string())]).take(pa.array(chosen))


def count_slice(low: np.ndarray, off: np.ndarray, langs: list[str], now: np.ndarray, old: np.ndarray | None, longest: int) -> Iterator[pa.RecordBatch]:
    """(language, length, phrase, occurrences) in some texts: of phrases whose two
    subphrases are active ``now`` and were not at this shard's last scan (``old``;
    None at its first scan, which counts the words too)."""
    start, end, left, text = pieces(low, off)
    if len(start) == 0:
        return
    h = RollingHash(low).firm(start, end)
    names = sorted(set(langs))
    known = pa.array(names, pa.string())
    code = np.array([names.index(x) for x in langs])[text]
    gap = IS_GAP[low]
    odd = gap & (low != 0x20)
    odd[1:] |= gap[1:] & gap[:-1]
    gaps = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
    ids = None  # of all words, where many are needed

    def rows(lang: np.ndarray, k: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([known.take(pa.array(lang)), pa.array(np.full(len(n), k, np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "k", "phrase", "n"])

    def counted(pos: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        # exact numbers of the phrases: those of their words one after another
        if len(pos) == 0:
            return
        nonlocal ids
        if ids is None and 4 * len(pos) >= len(start):
            ids = numbered(low, start, end)
        own = ids
        if own is None:
            needed = np.zeros(len(start), bool)
            for j in range(k):
                needed[pos + j] = True
            own = np.zeros(len(start), np.int64)
            own[needed] = numbered(low, start[needed], end[needed])
        vocabulary = int(own.max()) + 1
        c, bound = code[pos], len(names)
        for j in range(k):
            if bound * vocabulary >= 1 << 62:
                u, c = np.unique(c, return_inverse=True)
                bound = len(u)
            c = c * vocabulary + own[pos + j]
            bound *= vocabulary
        _, first, n = np.unique(c, return_index=True, return_counts=True)
        first = pos[first]
        a, b = start[first], end[first + k - 1]
        cuts = np.flatnonzero(np.diff(np.cumsum(b - a) // HANDED_BYTES, prepend=0)).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(first)]):
            if i < j:
                yield rows(code[first[i:j]], k, _joined(low, gaps, a[i:j], b[i:j]).cast(pa.string()), n[i:j])

    if old is None:
        yield from counted(np.arange(len(start)), 1)
        each = np.bincount(code, minlength=len(names))
        spoken = np.flatnonzero(each)
        yield rows(spoken, 0, pa.array([""] * len(spoken), pa.string()), each[spoken])
    g = np.array([lang_hash(x) for x in names], np.uint64)[code] * np.uint64(BASE) + h
    key = mix(g * np.uint64(MIX_A))
    active = _isin(now, key)
    before = np.zeros(len(start), bool) if old is None else _isin(old, key)
    for k in range(2, longest + 1):
        pos = np.flatnonzero(active[:-1] & active[1:] & (left[:-1] >= k))
        was = before[pos] & before[pos + 1]
        yield from counted(pos[~was], k)
        if k == longest or len(pos) == 0:
            break
        g[pos] = g[pos] * np.uint64(BASE) + h[pos + k - 1]
        key = mix(g[pos] * np.uint64(MIX_A))
        active, before = np.zeros(len(start), bool), np.zeros(len(start), bool)
        active[pos] = _isin(now, key)
        if old is not None:
            before[pos] = _isin(old, key) & was


def _scan(shard: DataFrame, now: bytes, old: bytes | None, longest: int) -> DataFrame:
    tables = shard.sparkSession.sparkContext.broadcast((now, old))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = (None if x is None else np.frombuffer(x, np.uint64) for x in tables.value)
        for rows, raw, off in slices(batches, "text", COUNT_BYTES):
            yield from count_slice(LOWER[raw], off, rows.column(0).to_pylist(), now, old, longest)

    return shard.select("lang", "text").mapInArrow(run, ROWS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _totals(rows: DataFrame, threshold: int) -> DataFrame:
    """Phrases of stored counts that sum up to the threshold.  One that reaches it has
    a ``heavy`` count, of its share of the threshold, in some shard: a bit table of
    these (fixed size) keeps the many rare phrases out of the shuffle."""
    keyed = rows.withColumn("h", F.xxhash64("lang", "k", "phrase"))
    heavy = keyed.where("heavy")
    may = _marked(keyed.where("not heavy"), "h", heavy).where("_has").drop("_has")
    return _summed(heavy.unionByName(may), threshold)


def _summed(rows: DataFrame, threshold: int) -> DataFrame:
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= threshold)


def _activated(reached: DataFrame, bits: int) -> np.ndarray:
    """The activation table: a bit for each phrase that reached the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            keys = phrase_keys(b.column(0).to_pylist(), [p.encode() for p in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array((keys & np.uint64(bits - 1)).view(np.int64))], names=["slot"])

    slots = reached.where("k >= 1").select("lang", "phrase").mapInArrow(run, "slot long")
    words = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b"))
    table = np.zeros(bits // 64, np.int64)
    for part in words.toArrow().to_batches():  # bits / 64 rows at most
        table[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return table


def frequent_phrases(df: DataFrame, longest: int = 5, threshold: int = 100, shards: int = 2, bits: int = 1 << 25, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Phrases of 1 to ``longest`` words that occur ``threshold`` times and more in
    their language, with their exact counts: (lang, k, phrase, f); k = 0 has a
    language's number of words.

    Dynamic itemset counting: the texts are dealt to ``shards``, which are scanned one
    after another in cycles.  The first scan of a shard counts its words; a longer
    phrase is counted from the next scan on once both of its subphrases have reached
    the threshold, through one full cycle: a scan of a shard counts what is active now
    and was not at the shard's last scan, so every phrase meets every shard once.
    After a scan, a phrase has reached the threshold if its counts of a share of it and
    more sum up to it; after cycle k, when all phrases of k words have gone their cycle,
    if all of its counts do, so the many rare counts are read once.  It ends when all
    shards were scanned with the last activations, after at most ``longest`` cycles.
    Activations are a bit table of fixed size: a false positive counts a phrase in vain
    and cannot change a result.

    What a scan finds is stored in the checkpoint folder and deleted at the end.
    """
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/phrases-{uuid.uuid4().hex}"
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    texts.where("text <> ''").withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(f"{root}/texts")
    texts = spark.read.schema("lang string, text string, shard int").parquet(f"{root}/texts")

    def stored(lengths: list[int]) -> DataFrame:
        paths = [p for k in lengths for p in counts.get(k, ())]
        return spark.read.schema("lang string, phrase string, n long, k int, heavy boolean").option("basePath", f"{root}/scans").parquet(*paths) if paths else empty

    def settle(k: int) -> None:
        """The exact counts of phrases of k words (with words, of languages)."""
        _totals(stored([0, 1] if k == 1 else [k]), threshold).write.parquet(f"{root}/settled/{k}")
        settled.append(f"{root}/settled/{k}")

    def known() -> DataFrame:
        return spark.read.schema("lang string, k int, phrase string, f long").parquet(*settled) if settled else empty.select("lang", "k", "phrase", F.col("n").alias("f"))

    empty = spark.createDataFrame([], "lang string, phrase string, n long, k int, heavy boolean")
    settled: list[str] = []
    counts: dict[int, list[str]] = {}  # folders by length
    now = np.zeros(bits // 64, np.int64)
    last: list[bytes | None] = [None] * shards
    for step in range(shards * longest):
        j = step % shards
        if last[j] != now.tobytes():
            old, last[j] = last[j], now.tobytes()
            found = _scan(texts.where(F.col("shard") == j), last[j], old, longest).withColumn("heavy", F.col("n") * shards >= threshold)
            _store(found.withColumn("scan", F.lit(step)), f"{root}/scans")
            for k in _lengths(spark, f"{root}/scans/scan={step}"):
                counts.setdefault(k, []).append(f"{root}/scans/scan={step}/k={k}")
        reached = _summed(stored(range(len(settled) + 1, longest)).where("heavy"), threshold)
        if j == shards - 1:
            settle(len(settled) + 1)
        if len(settled) < longest:
            now = now | _activated(known().unionByName(reached), bits)
        if all(x == now.tobytes() for x in last):
            break
    for k in range(len(settled) + 1, longest + 1):
        settle(k)
    out = cut_lineage(known())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def _store(found: DataFrame, root: str) -> None:
    """A scan's counts in folders by length and weight: a dozen at most, so a task
    keeps a file of each open and need not sort its rows."""
    conf = found.sparkSession.conf
    before = conf.get(WRITERS)
    conf.set(WRITERS, "64")
    try:
        found.write.mode("append").partitionBy("scan", "k", "heavy").parquet(root)
    finally:
        conf.set(WRITERS, before)


def _lengths(spark, folder: str) -> list[int]:
    """The lengths that a scan has stored counts of."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(path) if x.getPath().getName().startswith("k=")) if fs.exists(path) else []


def collocations(df: DataFrame, longest: int = 5, threshold: int = 100, top: int = 2000, share: int = 100, shards: int = 2, bits: int = 1 << 25,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` collocations.

    Words are lower-cased (A-Z) runs without space and tab in pieces between
    ``.,;:!?`` and line breaks.  Candidates are phrases of 2 to ``longest`` words with
    a = f(phrase) >= threshold.  Cut after its first words, a candidate has
    l = f(first part), r = f(rest) and score floor(1000 a n / (l r)), n the language's
    number of words; its lowest-scoring cut counts (of equal scores the first).  A
    candidate inside a longer one with 100 f(longer) >= share a is dropped.  Decimal
    arithmetic of 38 digits: exact.

    A null language is ``und``; null and empty texts have no words; repeated rows count
    each; other columns are ignored; an empty table gives an empty result.  Columns:
    lang, rank (by score and a descending, phrase by its bytes), phrase, a, l, r, n,
    score.
    """
    known = frequent_phrases(df, longest, threshold, shards, bits, text_col, lang_col)
    words = F.split("phrase", " ")
    cands = known.where("k >= 2").withColumnRenamed("f", "a")
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = cands.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c")).select(
        "lang", "phrase", "a", "c", part(F.lit(1), F.col("c")).alias("first"), part(F.col("c") + 1, F.size("words")).alias("rest")
    )
    counted = known.where("k >= 1")
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # a language may have most of the phrases: its number of words goes to SALTS places
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    words_of = known.where("k = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    cuts = cuts.withColumn("_salt", salt).join(words_of, ["lang", "_salt"])
    big = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(1000 * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "c", "l", "r")).alias("cut"))

    inner = F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    ))
    longer = cands.where("k >= 3").withColumn("words", words).select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_over"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("_over") * 100 < F.col("a") * share, F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
