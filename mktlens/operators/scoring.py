"""Fitted models as native column expressions.

A fitted pipeline (assembler, scaler, classifier) is read out once into a plain
table of numbers, which is what is saved; scoring is one SQL expression of the
feature columns, so it is part of the plan: no vectors, no Python, and any SQL engine
can restate it.  Missing values are 0 (the model matrix's rule, P20).
"""
from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.feature import StandardScalerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits of a nested expression from which its trees are summed as an array, which
#: the compiler cuts into several functions.
KINDS = ("logistic", "forest", "boosting")


def _nodes(java_node, value) -> list:
    """A tree as nested lists [feature, threshold, left, right]; ``value`` of leaves."""
    if java_node.numDescendants() == 0:
        return value(java_node)
    split = java_node.split()
    if not split.getClass().getSimpleName() == "ContinuousSplit":
        raise ValueError("splits of categories have no expression; index them as numbers")
    return [split.featureIndex(), split.threshold(), _nodes(java_node.leftChild(), value), _nodes(java_node.rightChild(), value)]


def _share(java_node) -> list[float]:
    """The class shares of a leaf."""
    n = list(java_node.impurityStats().stats())
    return [x / sum(n) if sum(n) else 0.0 for x in n]


def export(model: PipelineModel) -> dict:
    """The numbers of a fitted pipeline: columns, shift and scale of each, and the
    classifier's weights or trees.  Logistic regressions, trees, forests and boosted
    trees of two classes."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    scaler = next((s for s in model.stages if isinstance(s, StandardScalerModel)), None)
    columns = assembler.getInputCols()
    out: dict = {"columns": list(columns), "shift": [0.0] * len(columns), "scale": [1.0] * len(columns)}
    if scaler is not None:
        if scaler.getWithMean():
            out["shift"] = [float(x) for x in scaler.mean.toArray()]
        if scaler.getWithStd():  # a constant column scales to 0
            out["scale"] = [1.0 / x if x else 0.0 for x in map(float, scaler.std.toArray())]
    last = model.stages[-1]
    if last.numClasses != 2:
        raise ValueError("the probability of a rise needs two classes")
    if isinstance(last, LogisticRegressionModel):
        return out | {"kind": "logistic", "weights": [float(x) for x in last.coefficients.toArray()], "intercept": float(last.intercept)}
    if isinstance(last, DecisionTreeClassificationModel):
        return out | {"kind": "forest", "trees": [_nodes(last._java_obj.rootNode(), _share)]}
    if isinstance(last, RandomForestClassificationModel):
        return out | {"kind": "forest", "trees": [_nodes(t._java_obj.rootNode(), _share) for t in last.trees]}
    if isinstance(last, GBTClassificationModel):
        trees = [_nodes(t._java_obj.rootNode(), lambda n: n.prediction()) for t in last.trees]
        return out | {"kind": "boosting", "trees": trees, "weights": [float(w) for w in last.treeWeights]}
    raise ValueError(f"no expression for {type(last).__name__}")


def number(x: float) -> str:
    """A double literal that every engine reads alike."""
    text = repr(float(x))
    return text if "e" in text else f"{text}E0"


def _scaled(saved: dict, i: int) -> str:
    return f"((coalesce(CAST({saved['columns'][i]} AS DOUBLE), 0E0) - {number(saved['shift'][i])}) * {number(saved['scale'][i])})"


def _tree_sql(saved: dict, node, leaf) -> str:
    if not (isinstance(node, list) and len(node) == 4):
        return number(leaf(node))
    f, cut, left, right = node
    return f"CASE WHEN {_scaled(saved, f)} <= {number(cut)} THEN {_tree_sql(saved, left, leaf)} ELSE {_tree_sql(saved, right, leaf)} END"


def _sum(terms: Iterable[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def probability_sql(saved: dict, array_sum: str = "aggregate(array({0}), 0E0, (a, x) -> a + x)") -> str:
    """The probability of class 1 as SQL over the feature columns.  ``array_sum`` is
    how the engine adds up an array: many trees are one, as compilers cut arrays, but
    not sums, into several functions."""
    if saved["kind"] == "logistic":
        margin = _sum([number(saved["intercept"]), *[f"{_scaled(saved, i)} * {number(w)}" for i, w in enumerate(saved["weights"]) if w]])
        return f"(1E0 / (1E0 + exp(-{margin})))"
    if saved["kind"] == "forest":
        trees = [_tree_sql(saved, t, lambda p: p[1]) for t in saved["trees"]]
        return f"({array_sum.format(', '.join(trees))} / {number(len(trees))})"
    trees = [f"{number(w)} * ({_tree_sql(saved, t, lambda v: v)})" for t, w in zip(saved["trees"], saved["weights"])]
    return f"(1E0 / (1E0 + exp(-2E0 * {array_sum.format(', '.join(trees))})))"


def score(df: DataFrame, saved: dict, out: str = "probability_up") -> DataFrame:
    """``df`` with the probability of a rise.  Columns that the model knows and ``df``
    has not are 0."""
    absent = [c for c in saved["columns"] if c not in df.columns]
    scored = df.withColumns({c: F.lit(0.0) for c in absent}).withColumn(out, F.expr(probability_sql(saved)))
    return scored.drop(*absent)


def save(saved: dict, path: str) -> None:
    """A small text file; the driver's own, as a model is one for the whole cluster."""
    with open(path, "w") as f:
        json.dump(saved, f, indent=1)


def load(path: str) -> dict:
    with open(path) as f:
        saved = json.load(f)
    if saved.get("kind") not in KINDS:
        raise ValueError(f"{path} holds no exported model")
    return saved
