import collections
import math

import pytest

from mktlens.operators import language as L

DOCS = [
    (1, "the cat and the hat", "en"), (2, "le chat et le chapeau", "fr"), (3, "the chapeau", None), (4, "ab", "en"), (5, None, "fr"), (6, "", None),
    (7, "漢字仮名 \U0001f600 kana", "ja"), (8, "仮名 \U0001f600 the", None), (9, "THE CAT", None), (10, "zzzz zzzz", None), (11, "der Hut und die Katze " * 40, "de"), (12, "und die Katze", None),
]


def brute(docs):
    tri = lambda t: [t.lower()[i : i + 3] for i in range(len(t) - 2)]
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in docs:
        if lang and text and len(text) > 2:
            counts[lang].update(tri(text))
    v = len(set().union(*counts.values()))
    out = {}
    for key, text, _ in docs:
        t = tri(text or "")
        best = max((sum(math.log((c[x] + 1) / (sum(c.values()) + v)) for x in t), lang) for lang, c in counts.items())
        out[key] = best[1] if t else None
    return out


@pytest.mark.parametrize("cells", [L.CELLS, 160, 1])
def test_table_of_frequent_trigrams_loses_none(spark, monkeypatch, cells):
    """All trigrams in the tasks' table, some, or none: the same tags."""
    monkeypatch.setattr(L, "BLOCK", 64)  # texts cut into many blocks
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").repartition(3)
    profiles = L.train_profiles(df)
    got = L.tag_language(df, profiles, cells=cells)
    assert {r.doc_id: r.detected_language for r in got.collect()} == brute(DOCS)


def test_trigrams_never_leave_their_task_one_by_one(spark):
    """Where the table holds the profiles, a text leaves as one row of scores."""
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    plan = L.tag_language(df, L.train_profiles(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "trigram" not in plan
