"""Block matching against difflib, and J3 / J6 candidates against all pairs."""
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from mktlens.functions.similarity import ratios, sequence_ratio
from mktlens.operators import entity as E


def words(rng, n, alphabet, longest):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("alphabet,longest", [("ab", 12), ("abcdef ", 30), ("яблоко苹果🍎a", 9), ("xyz", 260)])
def test_block_matching_equals_difflib(alphabet, longest):
    rng = random.Random(longest)
    a, b = words(rng, 400, alphabet, longest), words(rng, 400, alphabet, longest)
    want = [SequenceMatcher(None, c, w).ratio() for w, c in zip(a, b)]
    assert ratios(a, b).tolist() == want
    assert ratios([], []).tolist() == []


def test_ratio_of_nulls(spark):
    rows = spark.createDataFrame([("ab", None), (None, "ab"), ("", ""), ("abc", "abd")], "w string, c string")
    assert [r[0] for r in rows.select(sequence_ratio(F.col("w"), F.col("c"))).collect()] == [None, None, 1.0, 2 * 2 / 6]


@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.34])
def test_candidates_lose_no_pair(spark, cutoff):
    rng = random.Random(7)
    names = sorted(set(words(rng, 150, "aabbcdeé ", 14)) - {""})
    asked = sorted(set(words(rng, 60, "aabbcdeé ", 14)) - {""})
    toks = spark.createDataFrame([(t, 0, t) for t in asked], "query string, pos int, token string")
    al = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "row_id long, alias string")
    got = {(r.token, r.alias) for r in E.fuzzy_candidates(toks, al, cutoff).collect()}
    want = {(t, n) for t in asked for n in names if SequenceMatcher(None, n, t).ratio() >= cutoff}
    assert want <= got
    if cutoff == 0.75:
        assert len(got) < 0.35 * len(names) * len(asked)


def test_substring_match_against_all_pairs(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abcd é") for _ in range(rng.randrange(0, 400)))) for i in range(120)]
    texts += [(1000, None), (1001, ""), (1002, "abcdefgh"), (1003, "xxabcdefghi"), (1004, "abcdefg"), (1005, "z" * 50_000 + "the long alias name")]
    names = sorted({t[a : a + n] for _, t in texts[:40] if t for a in (0, 7, 30) for n in (1, 2, 5, 8, 9, 20) if t[a : a + n]})
    names += ["abcdefgh", "bcdefghi", "abcdefghij", "the long alias name", "é é é é é é", "the long alias names"]
    aliases = spark.createDataFrame([(f"S{i % 50}", n) for i, n in enumerate(names)] + [("E", "")], "symbol string, alias string")
    items = spark.createDataFrame(texts, "item_id long, combined_norm string")
    got = {tuple(r) for r in E.match_text(items, aliases).collect()}
    assert got == {(i, f"S{k % 50}") for i, t in texts if t for k, n in enumerate(names) if n in t}
    assert E.match_text(items, aliases.limit(0)).count() == 0 and E.match_text(items.limit(0), aliases).count() == 0


def test_few_but_true_candidates_leave_the_tasks(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(words(rng, 60, "abcdefghij", 9))) for i in range(200)]
    names = sorted({t[5:25] for _, t in texts[:50]})
    keys = E.alias_keys(spark.createDataFrame([(n, n) for n in names], "symbol string, alias string")).cache()
    hits = E._key_hits(spark.createDataFrame(texts, "item_id long, t string"), "item_id", "t", E._key_table(keys))
    true = sum(n in t for n in names for _, t in texts)
    assert true <= hits.count() <= 2 * true
    keys.unpersist()
