"""Language tagging (F8) as a Spark job: character-trigram naive Bayes.

Training: tasks count the character trigrams of lower-cased texts with a known
language, Spark sums the counts per (language, trigram).  Scoring: the
log-likelihood of every language is
    n_trigrams * log P(unseen | lang) + sum over trigrams of (log P(t | lang) - log P(unseen | lang))
and the language with the largest one wins (``max_by``).  Texts without a trigram
get NULL.  Add-one smoothing over the shared vocabulary.

The profiles' frequent trigrams, a table of at most ``CELLS`` numbers, go to every
task, which adds up a text's gains at once; a text's other trigrams, which real
alphabets of thousands of characters have, meet the rest of the profiles in an
equi-join.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.llm._arrow import slices
from mktlens.session import cut_lineage

NGRAM = 3
CELLS = 1 << 21  # of the table of frequent trigrams: trigrams x languages
BLOCK = 1 << 20  # characters that a task looks at together
HELD = 1 << 20  # distinct trigrams that a task counts before it hands them on
POINT = 21  # bits of a code point


def _trigrams(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, text) of all overlapping character trigrams, in blocks: three code
    points in a number, and the text that holds them."""
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]  # in characters
    low = 0
    chars = raw if begins[-1] == len(raw) else np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    while low + NGRAM <= len(chars):
        block = chars[low : low + BLOCK + NGRAM - 1].astype(np.int64)
        code = (block[:-2] << 2 * POINT) | (block[1:-1] << POINT) | block[2:]
        own = np.repeat(np.arange(len(off) - 1), np.diff(np.clip(begins, low, low + len(code))))
        whole = np.arange(low + NGRAM, low + NGRAM + len(code)) <= begins[own + 1]
        yield code[whole], own[whole]
        low += BLOCK


def _strings(code: np.ndarray) -> pa.Array:
    """Trigrams as strings."""
    points = np.stack([code >> 2 * POINT, code >> POINT, code], axis=1) & ((1 << POINT) - 1)
    size = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _codes(trigrams: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(trigrams).encode("utf-32-le"), np.uint32).reshape(-1, NGRAM).astype(np.int64)
    return (points[:, 0] << 2 * POINT) | (points[:, 1] << POINT) | points[:, 2]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, trigram, c): the trigrams of a task's texts, counted by language."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, (code, c) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(code), np.int8))), _strings(code), pa.array(c)], names=["lang", "trigram", "c"])
        found.clear()

    for rows, raw, off in slices(batches, "text", 4 * BLOCK):
        langs = rows.column(0).dictionary_encode()
        names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for code, own in _trigrams(raw, off):
            spoken = lang[own]
            for i in np.unique(spoken).tolist():
                new, c = np.unique(code[spoken == i], return_counts=True)
                if names[i] in found:
                    old, before = found[names[i]]
                    new, at = np.unique(np.concatenate([old, new]), return_inverse=True)
                    c = np.bincount(at, np.concatenate([before, c])).astype(np.int64)
                found[names[i]] = new, c
            if sum(len(x) for x, _ in found.values()) > HELD:
                yield from counted()
    yield from counted()


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, trigram, logp, log_unseen) with add-one smoothing."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    g = known.select(F.col(lang_col).cast("string").alias("lang"), F.lower(text_col).alias("text")).mapInArrow(_count, "lang string, trigram string, c long")
    # read for the vocabulary, the totals and the profile: counted once
    counts = cut_lineage(g.groupBy("lang", "trigram").agg(F.sum("c").alias("c")))
    vocab = counts.select("trigram").distinct().agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    # totals and vocab have one row per language / one row: broadcast-safe.
    tv = totals.crossJoin(F.broadcast(vocab))
    prof = counts.join(F.broadcast(tv), "lang")
    denom = F.col("total") + F.col("v")
    return prof.select("lang", "trigram", F.ln((F.col("c") + 1) / denom).alias("logp"), F.ln(1 / denom).alias("log_unseen"))


def _frequent(profiles: DataFrame, langs: list[str], cells: int) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(codes, gains by language) of the trigrams that some language has with at least
    a probability, so that there are at most ``cells`` gains; and that probability's
    logarithm, None where the table holds all trigrams."""
    most = profiles.groupBy("trigram").agg(F.max("logp").alias("_most"))
    n = max(len(langs), 1)
    least = None if most.limit(cells // n + 1).count() * n <= cells else float(np.log(n * n / cells))
    table = profiles if least is None else profiles.join(most.where(F.col("_most") >= least), "trigram")
    found = table.select("trigram", "lang", (F.col("logp") - F.col("log_unseen")).alias("gain")).toArrow()
    names = found["trigram"].combine_chunks().dictionary_encode() if len(found) else pa.array([], pa.string()).dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    code = _codes(names.dictionary.to_pylist())
    gains = np.zeros((n, len(code)))
    number = {x: i for i, x in enumerate(langs)}
    gains[[number[x] for x in found["lang"].to_pylist()], names.indices.to_numpy()] = found["gain"].to_numpy()
    order = np.argsort(code)
    return code[order], np.ascontiguousarray(gains[:, order]), least


def tag_language(docs: DataFrame, profiles: DataFrame, key: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(key, detected_language) for every input row (NULL for a text without a
    trigram); ``key`` is unique."""
    spark = docs.sparkSession
    profiles = cut_lineage(profiles)  # read for the languages, the table and the join
    known = profiles.select("lang", "log_unseen").distinct().orderBy("lang").collect()  # a row per language
    langs = [r["lang"] for r in known]
    code, gains, least = _frequent(profiles, langs, cells)
    shared = spark.sparkContext.broadcast((code, gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gains = shared.value
        for rows, raw, off in slices(batches, "text", BLOCK):
            texts = rows.num_rows
            n, score = np.zeros(texts), np.zeros((texts, len(gains)))
            rare, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for code, own in _trigrams(raw, off):
                n += np.bincount(own, minlength=texts)
                place = np.searchsorted(table, code)
                hit = np.zeros(len(code), bool) if not len(table) else table[np.minimum(place, len(table) - 1)] == code
                for i, gain in enumerate(gains):
                    score[:, i] += np.bincount(own[hit], gain[place[hit]], minlength=texts)
                if least is not None:
                    rare.append(code[~hit])
                    owner.append(own[~hit])
            where = np.searchsorted(np.concatenate(owner), np.arange(texts + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(score.ravel()), len(gains)).cast(pa.list_(pa.float64())),
                 pa.ListArray.from_arrays(pa.array(where), _strings(np.concatenate(rare)))], names=["_key", "_n", "_s", "_rare"],
            )

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("_key"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).mapInArrow(
        run, f"_key {kind}, _n double, _s array<double>, _rare array<string>"
    )
    parts = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["log_unseen"]).alias("u")) for r in known]) if known else F.expr("cast(array() as array<struct<lang string, u double>>)")
    if least is not None:
        scored = cut_lineage(scored)  # read for the table's part of the score and for the rest
    each = scored.select("_key", "_n", F.posexplode(parts).alias("_i", "l"), "_s").select("_key", "_n", "l.lang", F.expr("_s[_i]").alias("s"))
    if least is not None:
        rest = profiles.groupBy("trigram").agg(F.max("logp").alias("_most"), F.collect_list(F.struct("lang", (F.col("logp") - F.col("log_unseen")).alias("s"))).alias("_gain"))
        rare = scored.select("_key", "_n", F.explode("_rare").alias("trigram")).join(rest.where(F.col("_most") < least), "trigram")
        each = each.unionByName(rare.select("_key", "_n", F.explode("_gain").alias("g")).select("_key", "_n", "g.lang", "g.s"))
    unseen = F.broadcast(spark.createDataFrame(known, "lang string, log_unseen double"))
    score = each.groupBy("_key", "_n", "lang").agg(F.sum("s").alias("s")).join(unseen, "lang")
    best = score.groupBy("_key", "_n").agg(F.max_by("lang", F.struct(F.col("_n") * F.col("log_unseen") + F.col("s"), "lang")).alias("lang"))
    return best.select(F.col("_key").alias(key), F.when(F.col("_n") > 0, F.col("lang")).alias("detected_language"))
