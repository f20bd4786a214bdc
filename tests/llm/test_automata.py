import hashlib
import re

import numpy as np
import pytest

from conftest import SF01
from mktlens.llm import automata

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n):
    least = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for j in range(len(w) - n + 1) if i is not None else ():
            x = tuple(w[j : j + n])
            least[x] = min(least.get(x, i), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        cut = set()
        for j in range(len(w) - n + 1) if i is not None else ():
            if least[tuple(w[j : j + n])] < i:
                cut |= set(range(j, j + n))
        kept = " ".join(x for j, x in enumerate(w) if j not in cut)
        out.append((i, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest(), None if t is None else kept))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in automata.remove_repeats(df, **kw).collect()), key=str)


@pytest.mark.parametrize("hot", [1000, 0])
def test_repeats_of_words_against_brute_force(spark, hot):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(300).collect()]
    first = docs[0][1].split()
    passage = " ".join(f"p{i}" for i in range(30))
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \x0b\x0c\r\n\t"), (10**6 + 3, "\x0b".join(first[:13])), (10**6 + 4, "\n ".join(first[:12])),
             (10**6 + 5, docs[0][1]), (10**6 + 5, docs[0][1]), (10**6 + 5, docs[1][1]), (None, docs[2][1]), (-5, docs[3][1]),
             (10**6 + 6, "w " * 40_000), (10**6 + 7, "w " * 500), (10**6 + 8, "a b " * 300), (10**6 + 9, "b a " * 250),
             # the same window twice in one document only is no copy
             (10**6 + 10, passage.replace("p", "q") + " x " + passage.replace("p", "q"))]
    docs += [(2 * 10**6 + i, f"x{i} y{i} {passage} z{i} " + " ".join(f"v{i}_{j}" for j in range(i % 20)) + f" {passage[:60]}") for i in range(80)]
    df = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, n_words int, sd string")
    got = run(df, hot=hot)
    assert got == brute(docs, 13)
    if hot:
        # a saturated table changes nothing; other widths, an empty table
        assert run(df, bits=64) == got
        assert run(df, n=4, k=2) == brute(docs, 4)
        assert run(df.limit(0)) == []


def test_many_small_automata_give_the_same(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(200).collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(df, shard_bytes=300) == brute(docs, 13)


def test_string_ids_small_vocabulary_and_long_words(spark):
    rng = np.random.default_rng(5)
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[x] for x in thue), "".join("ba"[x] for x in thue)
    docs = [(f"d{i:03d}", " ".join(rng.choice(list("xyz"), 60))) for i in range(150)]
    docs += [("long1", " ".join([a] * 13)), ("long2", " ".join([b] * 13)), ("ß", docs[0][1]), ("", docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    for n, k in [(13, 5), (3, 1), (1, 1), (5, 5)]:
        assert run(df, n=n, k=k) == brute(docs, n)


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(automata, "grams", lambda h, at, k, factor: np.zeros(len(at), np.uint64))
    got = automata.located([b"a b c d", b"b c d", b"c d e", b"x y z"], [1, 2, 3, 4], [1, 2, 3, 9], 3)
    assert got == [[(1, 1, 1)], [(0, 0, 1)], [], [(0, 0, 4)]]
    got = automata.located([b"a b c d e f", b"c d e g"], [1, 2], [3, 2], 2)
    assert got == [[(0, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1)], [(0, 0, 1), (1, 1, 1)]]
