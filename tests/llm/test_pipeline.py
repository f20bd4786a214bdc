import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from brute import contamination, later_copies, near_duplicates


def small(spark, tmp_path):
    rng = np.random.default_rng(3)
    en, fr = "the and of that with from this only for are".split(), "le la les des que une est dans pour avec".split()
    text = lambda words, n: " ".join(rng.choice(words, n)) + "".join(f" {x:x}q" for x in rng.integers(0, 2**40, 6))
    item = " ".join(f"item{i}word" for i in range(20))
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, text(en if i % 2 else fr, 80), "en" if i % 2 else "fr", "s") for i in range(40)]
    rows += [(50, rows[0][1], "fr", "t"), (50, rows[0][1], "fr", "t"), (51, None, "en", None), (52, "123", "en", "s"), (53, rows[1][1] + " " + item, "en", "s"),
             (54, rows[3][1] + " " + passage, "en", "s"), (55, text(fr, 70) + " " + passage + " end", "fr", "s")]
    rows = [(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages_against_brute_force(spark, tmp_path):
    path, rows, item = small(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    # language
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    out = pipeline.STAGES[0][1](spark, docs, path)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(kept)
    # near-duplicates: one of each class
    want = {c for _, _, c in near_duplicates([r[:2] for r in kept])}
    out = pipeline.STAGES[1][1](spark, out, path)
    got = sorted(map(tuple, out.collect()))
    assert [r[0] for r in got] == sorted(want) and set(got) <= set(kept) and out.columns == docs.columns
    # later copies go, first copies stay
    removed = dict(later_copies([r[:2] for r in got], 200))
    out = pipeline.STAGES[2][1](spark, out, path)
    cut = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and sum(removed.values()) > 200
    for i, t, *_ in got:
        assert (i in cut) == (removed[i] < len(t.encode()))
        if i in cut:
            assert len(cut[i].text.encode()) == len(t.encode()) - removed[i] and cut[i].n_chars == len(cut[i].text)
    # contamination
    bad = {i for i, *_, c in contamination([(r.doc_id, r.text) for r in cut.values()], [(1, item)]) if c}
    out = pipeline.STAGES[3][1](spark, out, path)
    left = {r.doc_id: r.text for r in out.collect()}
    assert bad and set(left) == set(cut) - bad and out.columns == docs.columns
    # packing
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = collections.Counter()
    for r in pipeline.run(spark, path).collect():
        total[r.doc_id] += r.length
    assert total == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}


def test_extra_columns_that_clash_and_empty_documents(spark, tmp_path):
    path, rows, _ = small(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as score", "'x' as kept", "2 as fp", "3 as n_words", "array(1) as spans", "4 as h")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), path).count() == 0


def test_classes_of_null_and_repeated_ids_stay_apart(spark, tmp_path):
    path, rows, _ = small(spark, tmp_path)
    a, b, c, d = (r[1] for r in rows[4:8])
    made = [(None, a), (None, b), (None, a), (9, c), (9, d), (9, c), (None, c)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = [tuple(r) for r in pipeline.STAGES[1][1](spark, docs, path).collect()]
    assert sorted(t for _, t in got) == sorted([a, b, c, d]) and set(got) <= set(made)
    # the whole pipeline packs them all
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in pipeline.run(spark, path).collect()) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in (a, b, c, d))


def test_readable_documents_pass_where_nothing_could_be_learned(spark):
    made = [(1, "words here", None), (2, None, None), (3, "12 !", None), (4, "日本語", None), (None, "more words", None), (5, "", None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    kept = {"words here", "日本語", "more words"}
    assert {r.text for r in pipeline.STAGES[0][1](spark, docs, "").collect()} == kept
    # all labelled rows are held out
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = spark.createDataFrame([(held, "the words", "en"), (held, "123", "en")], "doc_id long, text string, lang string")
    assert [r.text for r in pipeline.STAGES[0][1](spark, docs, "").collect()] == ["the words"]


def test_language_decisions_take_effect(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = {"en": "the and of that with from this only for are".split(), "fr": "le la les des que une est dans pour avec".split(),
             "de": "der die das und nicht ein ist auf mit sich".split(), "es": "el los las del que una por con para como".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(list(words) * 20)]
    mixed = [(1000 + i, " ".join(text(lang, 15) for lang in words), None) for i in range(6)]
    rows += mixed + [(2000, None, "en"), (2001, "12 34", "en"), (2002, text("de", 50) + " " + text("en", 8), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {r.doc_id for r in pipeline.language_stage(spark, docs, "").collect()}
    assert left == {i for i, *_ in rows} - {i for i, *_ in mixed} - {2000, 2001}
    monkeypatch.setattr(pipeline, "LANGUAGES", ("de", "es"))
    assert {r.doc_id for r in pipeline.language_stage(spark, docs, "").collect()} == {i for i, _, lang in rows[:80] if lang in ("de", "es")} | {2002}
    # labels that nobody may learn from decide nothing
    unlabelled = docs.withColumn("lang", docs.lang.substr(100, 1)).replace("", None, "lang")
    assert {r.doc_id for r in pipeline.language_stage(spark, unlabelled, "").collect()} == {i for i, *_ in rows} - {2000, 2001}


def test_rows_of_one_text_keep_a_defined_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", lang, "s") for lang in ("en", "fr", "de")], "doc_id long, text string, lang string, source string")
    kept = {tuple(pipeline.near_duplicate_stage(spark, docs.repartition(n), "").first()) for n in (1, 2, 3)}
    assert len(kept) == 1
