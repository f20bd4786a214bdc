import hashlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from mktlens.llm import iblt, language, queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, SF01).join(docs, "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.97


def test_edge_texts_and_clashing_columns(spark):
    train = spark.createDataFrame([("the and of the thing", "en"), ("le la les des que une est", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language.train(train)
    assert model.languages == ("en", "fr")
    texts = [None, "", "123 !!", "—…", "日本語", "THE AND OF THE", "le la les", "the " * 50_000, "le la les", "the thing of the and le la les des que une est " * 20]
    df = spark.createDataFrame([(i % 8, t, 1, "x") for i, t in enumerate(texts)], "doc_id int, text string, score int, lang_pred string")
    got = {r.text: r for r in language.identify(df.withColumn("t", F.col("text")), model, carry="t").withColumnRenamed("t", "text").collect()}
    assert len(got) == len(set(texts))
    assert [got[t].lang_pred for t in texts[:4]] == ["und"] * 4 and all(got[t].score == 0 for t in texts[:4])
    assert got["日本語"].lang_pred in model.languages
    assert (got["THE AND OF THE"].lang_pred, got["le la les"].lang_pred, got[texts[7]].lang_pred) == ("en", "fr", "en")
    mixed = got[texts[-1]].languages
    assert set(mixed) == {"en", "fr"} and abs(sum(mixed.values()) - 1) < 1e-6 and 0.2 < mixed["en"] < 0.8
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(df.limit(0), model).count() == 0


def test_no_training_rows(spark):
    model = language.train(spark.createDataFrame([("a", None)], "text string, lang string"))
    df = spark.createDataFrame([(1, "words here")], "doc_id int, text string")
    assert language.identify(df, model).first().lang_pred == "und"


def units(data):
    digest, _ = iblt.paragraphs(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))
    assert len(set(digest.tolist())) == len(digest)
    return set(digest.tolist())


def likeness(a, b):
    p, q = units(a.encode()), units(b.encode())
    return 2 * len(p & q) / (len(p) + len(q)) if p or q else 1.0


def test_fingerprints_against_sets(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(150).collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "é"), (10**6 + 3, "ab\n\nab\n\nab"), (None, "first"), (10**6 + 4, docs[0][1]), (10**6 + 5, "long line " * 30_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_chars string").repartition(5)
    got = {r.doc_id: r for r in iblt.fingerprints(df).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(t, edited)) < 1e-9 and abs(r.near_next - likeness(t, after)) < 1e-9
    assert got[docs[0][0]].fingerprint == got[10**6 + 4].fingerprint
    assert got[10**6].fingerprint == got[10**6 + 1].fingerprint


def test_fingerprints_of_one_none_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (1, "a\nb")], "doc_id long, text string")
    assert {(r.near_edited, r.near_next) for r in iblt.fingerprints(df).collect()} == {(iblt.compare(["a\nb"], ["a\nb"])[0][4], 1.0)}
    assert iblt.fingerprints(df.limit(0)).count() == 0
    assert iblt.fingerprints(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).first().near_next == 1.0


def test_peeling_recovers_the_digests():
    rng = np.random.default_rng(0)
    texts = ["\n".join(str(x) for x in rng.integers(0, 40, n)).encode() for n in (30, 35, 400)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    digest, poff = iblt.paragraphs(raw, off)
    sets = [set(digest[poff[i] : poff[i + 1]].tolist()) for i in range(3)]
    cells = 768
    tab = [iblt.tables(digest[poff[i] : poff[i + 1]], np.zeros(poff[i + 1] - poff[i], np.int64), np.ones(poff[i + 1] - poff[i], np.int64), 1, cells) for i in range(3)]
    _, found, sign, empty = iblt.peel(tab[0][0] - tab[1][0], tab[0][1] - tab[1][1], 1, cells)
    assert empty.all()
    assert set(found[sign == 1].tolist()) == sets[0] - sets[1] and set(found[sign == -1].tolist()) == sets[1] - sets[0]


def differing(digests, sides):
    """Differing digests of the one pair of texts that these are (sides: how many in the first)."""
    digest = np.array(digests, np.uint64)
    poff = np.array([0, sides, len(digest)], np.int64)
    count, total = iblt.tables(digest, np.repeat([0, 1], np.diff(poff)), np.ones(len(digest), np.int64), 2, iblt.BASE_CELLS)
    count, total = count.reshape(2, -1), total.reshape(2, 2, -1)
    return int(iblt.differences(digest, poff, np.array([0]), np.array([1]), count, total)[0])


def test_digests_of_equal_upper_bits_differ():
    rng = np.random.default_rng(5)
    top = int(rng.integers(1, 2**40)) << 24
    assert differing([top + 1, top + 2, 77], 2) == 3
    # the digest has 64 free bits: the low ones are no function of the upper ones
    digest, _ = iblt.paragraphs(np.frombuffer(b"a\nb\nc\nd\n", np.uint8), np.array([0, 8], np.int64))
    upper = digest >> np.uint64(24)
    again = iblt.check(upper) & np.uint64((1 << 24) - 1)
    assert (again != digest & np.uint64((1 << 24) - 1)).any()


def test_pairs_that_never_peel_are_counted_exactly(monkeypatch):
    # one digest twice on a side: a count of 2 in the same cells at every size
    assert differing([7, 7, 7, 9, 7, 8], 4) == 4
    sizes = []
    tables = iblt.tables
    monkeypatch.setattr(iblt, "tables", lambda *x: sizes.append(x[-1]) or tables(*x))
    assert differing([5] * 60, 50) == 40 and max(sizes) <= 4 * iblt.ENOUGH * 60
    assert differing(list(range(100, 600)), 250) == 500


def test_mixtures_of_many_languages(spark):
    names = "abcdefg"
    words = {n: [f"{n}{x}{n}{y}" for x in "kmst" for y in "kmst"] for n in names}
    model = language.train(spark.createDataFrame([(" ".join(w) * 20, n) for n, w in words.items()], "text string, lang string"))
    texts = [" ".join(" ".join(words[n]) for n in names[:k]) for k in range(1, 8)]
    got = {r.doc_id: r.languages for r in language.identify(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id int, text string"), model).collect()}
    for k, shares in got.items():
        assert set(shares) == set(names[:k]) and all(abs(v - 1 / k) < 0.02 for v in shares.values())
