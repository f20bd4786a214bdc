import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from mktlens.llm import phrases


def brute(docs, threshold, longest=5, top=2000, share=100):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= threshold}
    over = collections.Counter()
    for (lang, w), a in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                over[lang, w[i : i + k]] = max(over[lang, w[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in cands.items():
        if over[lang, w] * 100 >= share * a and over[lang, w]:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def run(df, **kw):
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).collect())


def test_collocations_against_brute_force(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(250).collect()]
    docs += [(None, "Big Data, big data! big  data\tsets big data\x0bsets"), ("und", "big data sets; big data"), ("en", None), ("en", ""), (None, None),
             ("xx", "a a a a a a"), ("xx", "É é. É é é b"), ("xx", "a a\na a,a"), ("zz", "one two three four five six. " * 5000), ("xx", "x\x00y \x1c z " * 3)]
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("p")).withColumn("k", F.lit(1))
    want = brute(docs, 3)
    assert len(want) > 1000
    assert run(df, threshold=3) == want
    # other numbers of shards, a saturated table, a low top, a longest length of 3, a wider share
    assert run(df, threshold=3, shards=1, bits=64) == want
    assert run(df, threshold=5, shards=3, top=7, longest=3, share=60) == brute(docs, 5, 3, 7, 60)
    assert run(df.limit(0)) == []


@pytest.mark.parametrize("longest", [2, 5])
def test_exact_beyond_64_bits(spark, longest):
    known = spark.createDataFrame([("en", 0, "", 10**14), ("en", 1, "a", 10**12 + 7), ("en", 1, "b", 10**12 + 9), ("en", 2, "a b", 10**12 + 3)], "lang string, k int, phrase string, f long")
    original, phrases.frequent_phrases = phrases.frequent_phrases, lambda *a: known
    try:
        got = phrases.collocations(known, longest).collect()
    finally:
        phrases.frequent_phrases = original
    assert [tuple(r) for r in got] == [("en", 1, "a b", 10**12 + 3, 10**12 + 7, 10**12 + 9, 10**14, 1000 * (10**12 + 3) * 10**14 // ((10**12 + 7) * (10**12 + 9)))]


def test_slices_hand_on_batches_of_bounded_bytes(monkeypatch):
    """Phrases leave a slice in Arrow batches cut from its bytes, odd gaps made one space."""
    monkeypatch.setattr(phrases, "HANDED_BYTES", 64)
    texts = [b"big data sets", b"big  data\tsets, big data", b"\tx \xc3\xa9\t\t y" + b"z" * 100 + b" x", b"", b"big data sets"]
    low = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    full = np.full(1, -1, np.int64).view(np.uint64)
    batches = list(phrases.count_slice(low, off, ["en", "en", "fr", "en", "xx"], full, None, 3))
    assert max(b.column(2).nbytes for b in batches if b.num_rows > 1) < 400
    got = collections.Counter()
    for b in batches:
        for lang, k, phrase, n in zip(*(c.to_pylist() for c in b.columns)):
            assert (lang, k, phrase) not in got
            got[lang, k, phrase] = n
    want = collections.Counter()
    for lang, text in zip(["en", "en", "fr", "en", "xx"], texts):
        for piece in text.decode().split(","):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang, 0, ""] += len(w)
            want.update((lang, k, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == +want
