import numpy as np
import pytest

from brute import classes, contamination, near_duplicates
from conftest import SF01
from mktlens.llm import decontamination, simhash
from mktlens.llm._graph import components


def test_contamination_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(400).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    items += [(1000, "Short ITEM here"), (1001, None), (1002, "  "), (1003, "zq"), (1004, "one two three four five six seven"), (1000, "other text"), (1005, items[0][1])]
    docs += [
        (10**6, None), (10**6 + 1, ""), (10**6 + 2, "a short item here zq"), (10**6 + 3, "xx ONE two-three four Five six seven, one two three four five six seven"),
        (10**6 + 4, items[0][1]), (10**6 + 4, items[1][1] + " " + items[1][1]), (10**6 + 5, "zq zq zq"), (10**6 + 6, "foo " + " ".join(items[2][1].split()[2:20])),
        (None, items[3][1]), (10**6 + 7, "filler " * 40_000 + items[4][1]),
    ]
    d = spark.createDataFrame([(*x, "a") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontamination.contamination(d, b).drop("items").collect()), key=str)
    assert got == sorted(contamination(docs, items), key=str)
    assert decontamination.contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(d.limit(0), b).count() == 0
    # a saturated filter changes nothing
    assert sorted((tuple(r) for r in decontamination.contamination(d, b, bits=64).drop("items").collect()), key=str) == got


def test_near_duplicates_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").limit(300).collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "\x0ba\x0bB  c\n\nd"), (10**6 + 3, " x"), (10**6 + 4, "x "), (10**6 + 5, docs[0][1]), (10**6 + 5, docs[0][1]), (10**6 + 6, "w " * 70_000)]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, fp int")
    got = sorted(tuple(r) for r in simhash.near_duplicates(df).drop("fp").collect())
    assert got == sorted(near_duplicates(docs))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_links_in_dense_groups(spark, distance):
    rng = np.random.default_rng(distance)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (12, 60, 2)).astype(np.uint64), axis=2)
    points = np.unique(np.concatenate([(centre[:, None] ^ flips).ravel(), np.array([0, 1, 2**64 - 1], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    root = {int(r.node): int(r.root) for r in components(simhash.links(df, distance)).collect()}
    want = classes(points.tolist(), lambda a, b: (a ^ b).bit_count() <= distance)
    seen = {}
    for p, c in zip(points.view(np.int64).tolist(), want):
        assert seen.setdefault(c, root.get(p, p)) == root.get(p, p)
    assert len(set(seen.values())) == len(seen)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    root = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(root.values()) == {0, 1000} and all(root[i] == 0 for i in range(41))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
