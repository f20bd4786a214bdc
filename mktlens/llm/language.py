"""Language identification by mixture inference over n-gram likelihoods."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.llm._arrow import carried, slices

BINS = 1 << 15  # hashed trigrams of a language
SMOOTHING = 0.5
MAX_LANGUAGES = 256
UNKNOWN = "und"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("a") : ord("z") + 1] = True
IS_LETTER[128:] = True


@dataclass(frozen=True)
class Model:
    """Log probabilities of hashed trigrams, one row per language."""

    languages: tuple[str, ...]
    logp: np.ndarray


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of the byte trigram around every letter byte, first of them of each
    word, offsets of each text in words).  Words are runs of ASCII letters and
    non-ASCII bytes in lower case; all else, and a text's ends, is one blank."""
    n = len(raw)
    low = LOWER[raw]
    # capital letters of the Latin-1 range: C3 80 to C3 9E, without the times sign
    capital = np.zeros(n, bool)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low[capital] += 0x20
    letter = IS_LETTER[low]
    low[~letter] = 0x20
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.full(n, 0x20, np.uint32)
    before[1:] = np.where(edge[1:n], 0x20, low[:-1])
    after = np.full(n, 0x20, np.uint32)
    after[:-1] = np.where(edge[1:n], 0x20, low[1:])
    at = np.flatnonzero(letter)
    code = (before[at] << np.uint32(16)) | (low[at].astype(np.uint32) << np.uint32(8)) | after[at]
    bins = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)  # the upper 15 bits
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:n]
    start = np.flatnonzero(begin)
    return bins, np.searchsorted(at, start), np.searchsorted(start, off)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts of all labelled rows (null labels are left out), combined in
    each task and summed by Spark.  The driver gets languages x BINS numbers at
    most, whatever the input; more than MAX_LANGUAGES labels raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows, raw, off in slices(batches, "text"):
            if not len(raw):
                continue
            bins, word, woff = trigrams(raw, off)
            ends = np.append(word, len(bins))[woff]  # offsets of each text in bins
            code = rows.column(1).dictionary_encode()
            langs = np.repeat(code.indices.to_numpy(), np.diff(ends))
            names = code.dictionary.to_pylist()
            counts = np.bincount(langs * BINS + bins, minlength=len(names) * BINS).reshape(len(names), BINS)
            for name, c in zip(names, counts):
                if name in total:
                    total[name] += c
                else:
                    total[name] = c.copy()
                if len(total) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bin", "n"])

    rows = (
        df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .where("text is not null and lang is not null")
        .mapInArrow(run, "lang string, bin int, n long")
        .groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    )
    found = rows.limit(MAX_LANGUAGES * BINS + 1).toArrow()  # one pass; more rows mean more languages
    names = sorted(set(found["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES or len(found) > MAX_LANGUAGES * BINS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(names), BINS))
    if names:
        counts[np.searchsorted(np.array(names), np.array(found["lang"].to_pylist())), found["bin"].to_numpy()] = found["n"].to_numpy()
    logp = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * BINS)
    return Model(tuple(names), logp.astype(np.float32))


def mixtures(like: np.ndarray, woff: np.ndarray, allowed: np.ndarray, rounds: int, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many texts at once: (proportions of each
    text, log likelihood of each, without the words' own scale).

    ``like``: words x languages; ``allowed``: texts x languages.  Texts whose
    proportions have settled take no part in further rounds."""
    count = np.diff(woff)
    pi = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    active = np.flatnonzero(count)
    sub, own = like, np.repeat(np.arange(len(active)), count[active])
    first = (np.cumsum(count) - count)[active]
    for _ in range(rounds):
        if not len(active):
            break
        r = sub * pi[active][own]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        new = np.add.reduceat(r, first, axis=0) / count[active][:, None]
        moved = np.abs(new - pi[active]).max(axis=1) > tolerance
        pi[active] = new
        if moved.sum() < 0.7 * len(active):
            keep = moved[own]
            sub = sub[keep]
            active = active[moved]
            own = np.repeat(np.arange(len(active)), count[active])
            first = np.cumsum(count[active]) - count[active]
    full = np.flatnonzero(count)
    total = np.zeros(len(count))
    if len(full):
        own = np.repeat(full, count[full])
        total[full] = np.add.reduceat(np.log(np.maximum((like * pi[own]).sum(axis=1), 1e-30)), (np.cumsum(count) - count)[full])
    return pi, total


def infer(word_logs: np.ndarray, woff: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions over all languages, proportions over the selected set).

    The candidates are the best single language, the two and three languages of the
    largest proportions, and one more as long as the last gained; the set of the
    highest log likelihood less half a log(words) per extra language wins."""
    count = np.diff(woff)
    texts, langs = len(count), word_logs.shape[1]
    top = word_logs.max(axis=1, keepdims=True) if len(word_logs) else word_logs
    like = np.exp(np.maximum(word_logs - top, -60))
    full, _ = mixtures(like, woff, np.ones((texts, langs)), rounds)
    total = np.zeros((texts, langs))
    some = np.flatnonzero(count)
    if len(some):
        total[some] = np.add.reduceat(np.log(like), (np.cumsum(count) - count)[some], axis=0)
    best = np.eye(langs)[total.argmax(axis=1)]
    score = total.max(axis=1)
    order = np.argsort(-full, axis=1, kind="stable")
    gained = np.ones(texts, bool)
    for m in range(2, langs + 1):
        # only texts where an m-th language has any weight can gain from it
        may = np.flatnonzero(gained & (np.take_along_axis(full, order[:, m - 1 : m], axis=1)[:, 0] > 1e-3))
        if not len(may):
            break
        allowed = np.zeros((len(may), langs))
        np.put_along_axis(allowed, order[may][:, :m], 1, axis=1)
        ends = np.cumsum(count[may])
        where = np.arange(int(ends[-1])) + np.repeat(woff[may] - (ends - count[may]), count[may])
        pi, ll = mixtures(like[where], np.concatenate([[0], ends]), allowed, rounds)
        ll -= 0.5 * (m - 1) * np.log(np.maximum(count[may], 2))
        better = ll > score[may]
        best[may[better]] = pi[better]
        score[may[better]] = ll[better]
        if m > 2:
            gained[may[~better]] = False
    return full, best


def identify(df: DataFrame, model: Model, rounds: int = 30, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, with_letters: bool = False) -> DataFrame:
    """Language proportions of every whole text, its main language and its share.

    Each word is drawn from one of the text's languages; its likelihood under a
    language is that of its trigrams.  Expectation-maximisation finds the
    proportions, penalised likelihood the set of languages, however many.  No
    shuffle; the model (languages x BINS numbers, bounded) goes to every task.

    Null texts, texts without a letter, and all texts of a model without
    languages: ``und``, score 0, no proportions.  Empty tables give an empty
    result; other columns are ignored, repeated rows each give a row; languages of
    equal proportions: the first by name.  Columns: the id, lang_pred, score (the
    main language's share of the words before selection), languages (map), and the
    column ``carry`` as it is, if given; with ``with_letters`` also letters: whether
    the text has one, whatever the model learned.
    """
    kind = df.schema[id_col].dataType.simpleString()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = shared.value
        for rows, raw, off in slices(batches, "text", 1 << 20):
            n = rows.num_rows
            letters = np.zeros(n, bool)
            full = best = np.zeros((n, len(names)))
            if len(raw):
                bins, word, woff = trigrams(raw, off)
                low = LOWER[raw]
                ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
                letters = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
                for i in np.flatnonzero(~letters & (np.diff(woff) > 0)).tolist():
                    letters[i] = any(map(str.isalpha, raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
                if len(word) and names:
                    logs = np.stack([np.add.reduceat(p[bins], word) for p in logp], axis=1).astype(np.float64)
                    full, best = infer(logs, woff, rounds)
            known = letters if names else np.zeros(n, bool)
            main = best.argmax(axis=1) if names else np.zeros(n, np.int64)
            share = full[np.arange(n), main] if names else np.zeros(n)
            keys, items, ends = [], [], [0]
            for i in range(n):
                if known[i]:
                    for j in np.flatnonzero(best[i] > 0).tolist():
                        keys.append(names[j])
                        items.append(float(best[i, j]))
                ends.append(len(keys))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *rows.columns[2:], pa.array([names[j] if k else UNKNOWN for j, k in zip(main.tolist(), known.tolist())], pa.string()),
                 pa.array(np.where(known, np.clip(share, 0, 1), 0.0)), pa.MapArray.from_arrays(ends, pa.array(keys, pa.string()), pa.array(items, pa.float64())),
                 *[pa.array(letters)] * with_letters],
                names=["id", *["_carry"] * bool(carry), "lang_pred", "score", "languages", *["letters"] * with_letters],
            )

    extra, more = carried(df, carry)
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra).mapInArrow(
        run, f"id {kind}, {more}lang_pred string, score double, languages map<string,double>{', letters boolean' * with_letters}"
    )
    return out.withColumnsRenamed({"id": id_col, "_carry": carry or "_carry"})


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
