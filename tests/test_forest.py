import math
import random

import numpy as np
import pytest

from mktlens.operators import forest as TF


def stats(x, a, b):
    part = x[a:b]
    m = sum(part) / len(part)
    mid = (len(part) - 1) / 2
    return [m, math.sqrt(sum((v - m) ** 2 for v in part) / len(part)), sum((v - m) * (i - mid) for i, v in enumerate(part)) / sum((i - mid) ** 2 for i in range(len(part)))]


def entropy(labels):
    return -sum(p * math.log2(p) for c in set(labels) if (p := labels.count(c) / len(labels)))


def grow(rows, edges, depth, least):
    """A tree as nested tuples, by trying every threshold of every feature."""
    labels = [y for _, y in rows]
    if depth == 0 or len(rows) < least or len(set(labels)) == 1:
        return sorted(labels)
    best = None
    for f, cuts in enumerate(edges):
        for cut in cuts:
            low, high = [y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]
            if low and high:
                gain = round(entropy(labels) - (len(low) * entropy(low) + len(high) * entropy(high)) / len(rows), 12)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, cut
    if best is None:
        return sorted(labels)
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], edges, depth - 1, least), grow([r for r in rows if r[0][f] > cut], edges, depth - 1, least)


def nested(forest, tree, node=0):
    if tree.feature[node] < 0:
        return sorted(c for c, n in zip(forest.classes, tree.counts[node]) for _ in range(n))
    return tree.feature[node], tree.threshold[node], nested(forest, tree, tree.left[node]), nested(forest, tree, tree.right[node])


@pytest.fixture(scope="module")
def series():
    rng = random.Random(3)
    out = []
    for i in range(240):
        y = rng.choice([0, 1, 2])
        x = [rng.gauss(0, 1) + (y == 1) * (t >= 10) * 1.5 + (y == 2) * t * 0.15 for t in range(16)]
        out.append((i, y, x))
    return out


def test_forest_equals_trees_grown_one_by_one(spark, series, monkeypatch):
    df = spark.createDataFrame([*series, (900, None, series[0][2]), (901, 1, [1.0]), (902, 1, None)], "id long, label int, values array<double>").repartition(5)
    kept = {}
    monkeypatch.setattr(TF, "_edges", lambda *a, f=TF._edges: kept.setdefault("edges", f(*a)))
    forest = TF.fit(df, trees=7, depth=4, bins=8, least_rows=5, seed=1)
    assert forest.classes == [0, 1, 2] and forest.length == 16
    assert len({tuple(t.intervals) for t in forest.trees}) == 7 and all(len(t.intervals) == 4 for t in forest.trees)
    for tree, edges in zip(forest.trees, kept["edges"]):
        assert all(0 < len(e) <= 7 for e in edges)
        rows = [([v for a, b in tree.intervals for v in stats(x, a, b)], y) for _, y, x in series]
        assert nested(forest, tree) == grow(rows, [e.tolist() for e in edges], 4, 5)

    got = {r.id: r for r in TF.predict(df, forest).collect()}
    for i, _, x in series:
        want = np.zeros(3)
        for tree in forest.trees:
            at, f = 0, [v for a, b in tree.intervals for v in stats(x, a, b)]
            while tree.feature[at] >= 0:
                at = tree.left[at] if f[tree.feature[at]] <= tree.threshold[at] else tree.right[at]
            want += np.array(tree.counts[at]) / sum(tree.counts[at])
        assert np.allclose(got[i].probabilities, want / 7) and got[i].prediction == forest.classes[int(np.argmax(want / 7))]
    assert got[901].probabilities is None and got[902].prediction is None and got[900].prediction is not None

    imp = TF.importances(spark, forest)
    rows = imp.collect()
    assert len(rows) == 7 * 4 * 3
    for t in range(7):
        assert sum(r.importance for r in rows if r.tree == t) == pytest.approx(1.0)
    over = {(r.stat, r.time): r.importance for r in TF.temporal_importances(imp, 16).collect()}
    assert len(over) == 48
    for stat in TF.STATS:
        for time in range(16):
            cover = [r.importance for r in rows if r.stat == stat and r.start <= time < r.end]
            assert over[stat, time] == pytest.approx(sum(cover) / len(cover) if cover else 0.0)


def test_thresholds_are_quantiles_and_result_does_not_depend_on_partitions(spark, series):
    df = spark.createDataFrame(series, "id long, label int, values array<double>")
    one, many = (TF.fit(df.repartition(n), trees=3, depth=3, bins=16) for n in (1, 9))
    assert [nested(one, t) for t in one.trees] == [nested(many, t) for t in many.trees]
    edges = TF._edges(df.select("label", "values"), [t.intervals for t in one.trees], 4)
    for tree, own in zip(one.trees, edges):
        f = TF.interval_stats(np.array([x for _, _, x in series]), tree.intervals)
        for k, cuts in enumerate(own):
            assert np.allclose([(f[:, k] <= c).mean() for c in cuts], [0.25, 0.5, 0.75], atol=0.03)


def test_hold_out_accuracy_one_class_and_no_rows(spark, series):
    df = spark.createDataFrame(series, "id long, label int, values array<double>")
    forest = TF.fit(df.where("id < 160"), trees=20, depth=5)
    scored = TF.predict(df.where("id >= 160"), forest).collect()
    assert sum(r.prediction == r.label for r in scored) / len(scored) > 0.8
    single = TF.fit(df.where("label = 1"), trees=2)
    assert {r.prediction for r in TF.predict(df.limit(5), single).collect()} == {1}
    with pytest.raises(ValueError):
        TF.fit(df.limit(0))


def test_memory_of_a_task_does_not_grow_with_its_rows(spark, series, monkeypatch):
    """Matrices of bounded rows; counts of bounded size, level by level."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), pa.array(np.zeros((20_000, 3)).tolist())], names=["label", "values"])
    sizes = [(b.num_rows, len(m)) for b, m in TF._matrix(iter([batch]))]
    assert sum(n for n, _ in sizes) == 20_000 and all(n == m <= TF.ROWS for n, m in sizes)
    df = spark.createDataFrame(series, "id long, label int, values array<double>").repartition(3)
    want = TF.fit(df, trees=4, depth=3, bins=8)
    monkeypatch.setattr(TF, "HELD", 500)
    assert TF.fit(df, trees=4, depth=3, bins=8) == want


def test_a_task_sums_its_counts(spark):
    """A row per cell leaves a task, however many batches it reads."""
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0])] * 2000, "label int, values array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        cells = TF._cells(df, lambda values, label: iter([(0, [7], 2, label)]))
        assert [tuple(r) for r in cells.collect()] == [(0, 7, 0, 2000)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_matrices_of_long_series_are_bounded():
    """Not only the rows of a matrix: its points, too."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(90)), pa.array(np.arange(900_000.0).reshape(90, -1).tolist())], names=["label", "values"])
    found = list(TF._matrix(iter([batch])))
    assert all(m.size <= 1 << 17 and b.num_rows == len(m) for b, m in found)
    assert np.array_equal(np.concatenate([m for _, m in found]), np.arange(900_000.0).reshape(90, -1))


def test_counts_of_one_tree_are_bounded(spark, series, monkeypatch):
    """Nodes of one tree, and features while the thresholds are sought, are counted in
    groups where they need more than HELD counts together; the trees stay the same."""
    df = spark.createDataFrame(series, "id long, label int, values array<double>").coalesce(1)
    want = TF.fit(df, trees=2, depth=4, bins=8)
    assert max(len(t.feature) for t in want.trees) > 15  # 8 nodes on the last level
    values, label, held = np.array([x for _, _, x in series]), np.array([y for _, y, _ in series]), []

    def spy(rows, count, f=TF._cells):
        held.append(sum(len(nodes) * size for _, nodes, size, _ in count(values, label)))
        return f(rows, count)

    monkeypatch.setattr(TF, "_cells", spy)
    monkeypatch.setattr(TF, "HELD", 2048)
    assert TF.fit(df, trees=2, depth=4, bins=8) == want
    assert max(held) <= 2048


def test_a_task_needs_little_beside_its_counts():
    """Python's peak while rows are counted, whatever their number: no second array of
    the counts' size, no large matrices."""
    import tracemalloc

    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, _):
            self.run = run
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self

    def peak(n):
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000) % 10), pa.array(list(np.ones((10_000, 64))))], names=["label", "values"])
        rows = Rows()
        TF._cells(rows, lambda values, label: ((t, [0], 1 << 20, label + TF.interval_stats(values, [(0, 64)])[:, 0].astype(int)) for t in range(3)))
        tracemalloc.start()
        try:
            assert sum(sum(b.column("n").to_pylist()) for b in rows.run(iter([batch] * n))) == 3 * 10_000 * n
            return tracemalloc.get_traced_memory()[1] / 2**20
        finally:
            tracemalloc.stop()

    few, many = peak(1), peak(6)
    assert many < few + 1 and many < 12 + 6  # 12 MB of counts
