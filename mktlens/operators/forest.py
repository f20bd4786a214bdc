"""Time-series forest (M12): every tree has random intervals of its own, and its
features are their mean, standard deviation and slope.

All trees grow together, a level at a time.  A level is one aggregate over the
series: tasks send each series down every tree and count (tree, node, feature,
bin, class) cells with numpy, Spark adds the cells up, and the best split of a node
is found from its cells, whose number the parameters bound.  What reaches the
driver is the model itself: splits and class counts of the nodes.
"""
from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.operators.samples import draw_intervals

STATS = ("mean", "std", "slope")
#: Cells of equal width per feature from which the bins (quantiles) are taken.
FINE = 1024
#: Series that a task looks at together, and their points, unless one series has more.
ROWS = 2048
POINTS = 1 << 17
#: Counts of four bytes that a task keeps; the nodes of a level are cut into groups that
#: need no more (unless one node does), counted one after another.
HELD = 1 << 23


@dataclass
class Tree:
    """Nodes in order of their making; a leaf has feature -1."""

    intervals: list[tuple[int, int]]
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    counts: list[list[int]] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, counts: list[int]) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.right.append(-1)
        self.counts.append(counts)
        self.gain.append(0.0)
        return len(self.feature) - 1


@dataclass
class Forest:
    length: int
    classes: list
    trees: list[Tree]


def interval_stats(values: np.ndarray, intervals: list[tuple[int, int]]) -> np.ndarray:
    """(rows, 3 x intervals): mean, population standard deviation and least-squares
    slope of every interval, interval by interval."""
    out = np.empty((len(values), 3 * len(intervals)))
    for k, (a, b) in enumerate(intervals):
        part = values[:, a:b]
        mean = part.sum(axis=1) / (b - a)
        apart = part - mean[:, None]
        at = np.arange(b - a) - (b - a - 1) / 2.0
        out[:, 3 * k] = mean
        out[:, 3 * k + 1] = np.sqrt((apart * apart).sum(axis=1) / (b - a))
        out[:, 3 * k + 2] = (apart * at).sum(axis=1) / max((at * at).sum(), 1e-300)
    return out


def route(tree: Tree, features: np.ndarray) -> np.ndarray:
    """The node that every row reaches."""
    node = np.zeros(len(features), np.int64)
    feature, threshold = np.array(tree.feature), np.array(tree.threshold)
    left, right = np.array(tree.left), np.array(tree.right)
    while True:
        moving = np.flatnonzero(feature[node] >= 0)
        if len(moving) == 0:
            return node
        at = node[moving]
        low = features[moving, feature[at]] <= threshold[at]
        node[moving] = np.where(low, left[at], right[at])


def best_split(cells: np.ndarray) -> tuple[int, int, float]:
    """(feature, last bin of the left side, gain) from counts (features, bins,
    classes): the greatest fall of entropy, to 12 decimals; of equal ones the first
    feature, then the lowest bin."""
    left = cells.cumsum(axis=1)[:, :-1]
    right = cells.sum(axis=1)[:, None] - left
    total = cells[0].sum(axis=0)

    def entropy(n: np.ndarray) -> np.ndarray:
        size = n.sum(axis=-1, keepdims=True)
        p = n / np.maximum(size, 1)
        return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)

    nl, nr = left.sum(axis=-1), right.sum(axis=-1)
    after = (nl * entropy(left) + nr * entropy(right)) / total.sum()
    gain = np.round(np.where((nl > 0) & (nr > 0), entropy(total) - after, -1.0), 12)
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    return f, b, float(gain[f, b])


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Series of one length as matrices of ROWS rows and POINTS points at most (one row
    of a longer series); missing points are 0."""
    for whole in batches:
        lists = whole.column(whole.schema.get_field_index("values"))
        points = len(lists.flatten()) // max(whole.num_rows, 1)
        rows = max(1, min(ROWS, POINTS // max(points, 1)))
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            column = b.column(b.schema.get_field_index("values"))
            flat = column.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            yield b, np.nan_to_num(flat).reshape(b.num_rows, -1)


def _cells(rows: DataFrame, count: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, list[int], int, np.ndarray]]]) -> DataFrame:
    """Adds up cell counts: ``count`` gives (tree, its nodes, cells of a node, number
    of the cell of every value, nodes one after another) of some series.  A task hands
    its sums on at its end, and earlier where they are more than HELD numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        layout: dict[int, tuple[list[int], int]] = {}
        one = np.int32(1)

        def summed() -> Iterator[pa.RecordBatch]:
            for tree in list(held):
                total = held.pop(tree)
                nodes, size = layout[tree]
                place = np.flatnonzero(total)
                node = np.array(nodes, np.int32)[place // size]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), tree, np.int32)), pa.array(node), pa.array((place % size).astype(np.int32)), pa.array(total[place].astype(np.int64))], names=["tree", "node", "cell", "n"]
                )

        for b, values in _matrix(batches):
            for tree, nodes, size, cell in count(values, b.column(0).to_numpy()):
                if tree not in held:
                    held[tree], layout[tree] = np.zeros(len(nodes) * size, np.int32), (nodes, size)
                np.add.at(held[tree], cell, one)  # in place: no second array of that size
                if sum(map(len, held.values())) > HELD:
                    yield from summed()
        yield from summed()

    return rows.mapInArrow(run, "tree int, node int, cell int, n long").groupBy("tree", "node", "cell").agg(F.sum("n").alias("n"))


def _groups(nodes: dict[int, list[int]], size: int) -> list[dict[int, list[int]]]:
    """The nodes of the trees in groups of HELD counts or one node at most, ``size``
    counts a node; only a tree that needs more by itself is in several."""
    most = max(1, HELD // size)
    groups: list[dict[int, list[int]]] = []
    room = 0
    for t, own in nodes.items():
        for at in range(0, len(own), most):
            part = own[at : at + most]
            if len(part) > room:
                groups.append({})
                room = most
            groups[-1][t] = part
            room -= len(part)
    return groups


def _ranges(rows: DataFrame, intervals: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) of every feature of every tree."""
    width = 3 * len(intervals[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((len(intervals), width), np.inf), np.full((len(intervals), width), -np.inf)
        seen = False
        for _, values in _matrix(batches):
            seen = True
            for t, own in enumerate(intervals):
                found = interval_stats(values, own)
                low[t], high[t] = np.minimum(low[t], found.min(axis=0)), np.maximum(high[t], found.max(axis=0))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(low.size, dtype=np.int32)), pa.array(low.ravel()), pa.array(high.ravel())], names=["f", "lo", "hi"])

    # a row per feature: bounded by the parameters
    found = rows.mapInArrow(run, "f int, lo double, hi double").groupBy("f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values("f")
    shape = (len(intervals), width)
    return found["lo"].to_numpy().reshape(shape), found["hi"].to_numpy().reshape(shape)


def _edges(rows: DataFrame, intervals: list[list[tuple[int, int]]], bins: int) -> list[list[np.ndarray]]:
    """Thresholds of every feature: borders of fine cells next to its quantiles,
    ``bins`` - 1 at most, from all rows."""
    low, high = _ranges(rows, intervals)
    step = np.where(high > low, (high - low) / FINE, 1.0)

    def count(values: np.ndarray, _: np.ndarray, group: dict[int, list[int]]) -> Iterator[tuple[int, list[int], int, np.ndarray]]:
        for t, features in group.items():
            at = np.clip(np.floor((interval_stats(values, intervals[t]) - low[t]) / step[t]), 0, FINE - 1).astype(np.int64)
            # a feature takes the place of a node
            yield t, features, FINE, (at[:, features] + np.arange(len(features)) * FINE).ravel()

    def quantiles(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cell")
        upto = group["n"].cumsum().to_numpy()
        want = upto[-1] * np.arange(1, bins) / bins
        cut = np.unique(group["cell"].to_numpy()[np.searchsorted(upto, want)])
        return pd.DataFrame({"tree": group["tree"].iloc[0], "node": group["node"].iloc[0], "cell": cut})

    # at most bins - 1 rows per feature: bounded by the parameters
    cuts = pd.concat([
        _cells(rows, partial(count, group=g)).groupBy("tree", "node").applyInPandas(quantiles, "tree int, node int, cell int").toPandas()
        for g in _groups({t: list(range(low.shape[1])) for t in range(len(intervals))}, FINE)
    ])
    edges = [[np.zeros(0) for _ in range(low.shape[1])] for _ in intervals]
    for (t, f), group in cuts.groupby(["tree", "node"]):
        found = low[t, f] + (np.sort(group["cell"].to_numpy()) + 1) * step[t, f]
        edges[t][f] = found[found < high[t, f]]
    return edges


def fit(df: DataFrame, values: str = "values", label: str = "label", trees: int = 100, depth: int = 6, bins: int = 32, least_rows: int = 2,
        n_intervals: int | None = None, seed: int = 42) -> Forest:
    """A forest over series of one length (the commonest; others, and rows without a
    label, are left out).  Every tree draws sqrt(length) intervals of its own and
    sees all rows; nodes split by entropy at quantile thresholds, down to ``depth``
    levels, pure nodes, or fewer than ``least_rows`` rows."""
    rows = df.where(F.col(label).isNotNull() & F.col(values).isNotNull()).select(F.col(label).alias("label"), F.col(values).cast("array<double>").alias("values"))
    size = rows.groupBy(F.size("values").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None or size["size"] < 3:
        raise ValueError("no labelled series of 3 points or more")
    length = size["size"]
    rows = rows.where(F.size("values") == length)
    counted = sorted(((r["label"], r["count"]) for r in rows.groupBy("label").count().collect()))  # a row per class
    classes = [x for x, _ in counted]
    intervals = [draw_intervals(length, random.Random(f"{seed} {t}").randrange(1 << 30), n_intervals) for t in range(trees)]
    forest = Forest(length, classes, [Tree(own) for own in intervals])
    for tree in forest.trees:
        tree.add([n for _, n in counted])
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    rows = rows.select(number.alias("label"), "values")
    edges = _edges(rows, intervals, bins)
    width, c = 3 * len(intervals[0]), len(classes)

    for _ in range(depth):
        growing = {t: [i for i, (f, n) in enumerate(zip(tree.feature, tree.counts)) if f < 0 and tree.gain[i] == 0.0 and sum(n) >= least_rows and max(n) < sum(n)]
                   for t, tree in enumerate(forest.trees)}
        growing = {t: nodes for t, nodes in growing.items() if nodes}
        if not growing:
            break

        def count(values: np.ndarray, label: np.ndarray, group: dict[int, list[int]]) -> Iterator[tuple[int, list[int], int, np.ndarray]]:
            for t, nodes in group.items():
                features = interval_stats(values, intervals[t])
                place = np.full(len(forest.trees[t].feature), -1)
                place[nodes] = np.arange(len(nodes))
                own = place[route(forest.trees[t], features)]
                inside = np.flatnonzero(own >= 0)
                if not len(inside):
                    continue
                first = own[inside] * (width * bins * c) + label[inside]
                columns = np.ascontiguousarray(features[inside].T)
                yield t, nodes, width * bins * c, np.concatenate([first + (f * bins + np.searchsorted(e, columns[f])) * c for f, e in enumerate(edges[t])])

        def split(group: pd.DataFrame) -> pd.DataFrame:
            cells = np.zeros(width * bins * c)
            cells[group["cell"].to_numpy()] = group["n"].to_numpy()
            cells = cells.reshape(width, bins, c)
            f, b, gain = best_split(cells)
            left = cells[f, : b + 1].sum(axis=0).astype(int).tolist()
            return pd.DataFrame({"tree": group["tree"].iloc[:1], "node": group["node"].iloc[:1], "feature": f, "bin": b, "gain": gain, "left": [left]})

        # a row per growing node: at most trees x 2 ** depth
        found = pd.concat([
            _cells(rows, partial(count, group=g)).groupBy("tree", "node").applyInPandas(split, "tree int, node int, feature int, bin int, gain double, left array<long>").toPandas()
            for g in _groups(growing, width * bins * c)
        ])
        for r in found.sort_values(["tree", "node"]).itertuples():
            tree = forest.trees[r.tree]
            if r.gain <= 0:
                tree.gain[r.node] = -1.0  # nothing to win: a leaf for good
                continue
            tree.feature[r.node], tree.threshold[r.node], tree.gain[r.node] = r.feature, float(edges[r.tree][r.feature][r.bin]), r.gain
            left = [int(x) for x in r.left]
            tree.left[r.node] = tree.add(left)
            tree.right[r.node] = tree.add([n - x for n, x in zip(tree.counts[r.node], left)])
    return forest


def predict(df: DataFrame, forest: Forest, values: str = "values") -> DataFrame:
    """``df`` with probabilities (per class, the mean of the leaves' shares) and
    prediction (the first class of the greatest); null for a series of another length."""
    label = "bigint" if all(isinstance(x, int) for x in forest.classes) else "double" if all(isinstance(x, (int, float)) for x in forest.classes) else "string"
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        share = [np.array(t.counts) / np.maximum(np.sum(t.counts, axis=1, keepdims=True), 1) for t in forest.trees]
        for b in batches:
            column = b.column(b.schema.get_field_index("values"))
            fits = np.array([x is not None and x == forest.length for x in pa.compute.list_value_length(column).to_pylist()], bool)
            p = np.zeros((b.num_rows, len(forest.classes)))
            if fits.any():
                found = p[fits]
                at = 0
                for _, matrix in _matrix(iter([b.filter(pa.array(fits))])):
                    for tree, own in zip(forest.trees, share):
                        found[at : at + len(matrix)] += own[route(tree, interval_stats(matrix, tree.intervals))]
                    at += len(matrix)
                p[fits] = found
            p /= len(forest.trees)
            best = [forest.classes[i] if ok else None for i, ok in zip(p.argmax(axis=1).tolist(), fits.tolist())]
            probabilities = [x if ok else None for x, ok in zip(p.tolist(), fits.tolist())]
            rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "values"]
            kind = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[label]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(probabilities, pa.list_(pa.float64())), pa.array(best, kind)],
                                             names=[*[n for n in b.schema.names if n != "values"], "probabilities", "prediction"])

    keep = [c for c in df.columns if c not in (values, "probabilities", "prediction")]
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    rows = df.select(*keep, F.col(values).cast("array<double>").alias("values"))
    return rows.mapInArrow(run, f"{kinds}probabilities array<double>, prediction {label}")


def importances(spark, forest: Forest) -> DataFrame:
    """(tree, interval, start, end, stat, importance): the falls of entropy at a tree's
    splits, weighted by rows, as shares of the tree's."""
    rows = []
    for t, tree in enumerate(forest.trees):
        own = np.zeros(3 * len(tree.intervals))
        for f, gain, n in zip(tree.feature, tree.gain, tree.counts):
            if f >= 0:
                own[f] += gain * sum(n)
        own /= own.sum() or 1.0
        rows += [(t, k, a, b, s, float(own[3 * k + i])) for k, (a, b) in enumerate(tree.intervals) for i, s in enumerate(STATS)]
    return spark.createDataFrame(rows, "tree int, interval int, start int, end int, stat string, importance double")


def temporal_importances(by_interval: DataFrame, length: int) -> DataFrame:
    """(stat, time, importance): the mean importance of the intervals that cover a
    point of time; 0 where none does."""
    covered = by_interval.select("stat", F.explode(F.sequence("start", F.col("end") - 1)).alias("time"), "importance")
    mean = covered.groupBy("stat", "time").agg(F.avg("importance").alias("_mean"))
    grid = by_interval.select("stat").distinct().select("stat", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("time"))
    return grid.join(mean, ["stat", "time"], "left").select("stat", "time", F.coalesce("_mean", F.lit(0.0)).alias("importance"))
