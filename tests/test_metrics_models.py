"""Metrics against closed-form / brute-force computations; model operators."""
import math
import random

import pytest
from pyspark.sql import functions as F

from mktlens.config import ModelConfig
from mktlens.operators import metrics as M
from mktlens.operators import models as MD


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = 0.0
    for p in pos:
        for n in neg:
            tot += 1.0 if p > n else 0.5 if p == n else 0.0
    return tot / (len(pos) * len(neg))


def test_auc_matches_pair_count(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(400)]  # many ties
    df = spark.createDataFrame(pairs, "y int, s double")
    got = M.roc_auc(df, F.col("y") == 1, F.col("s"), n_parts=7).first().roc_auc
    assert abs(got - brute_auc(pairs)) < 1e-12


def test_binary_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int")
    r = M.binary_report(df, F.col("t"), F.col("p")).first()
    assert (r.accuracy, r.precision_up, r.recall_up, r.f1_up) == (1.0, 0.0, 0.0, 0.0)


def test_log_loss_clipping(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (0, [0.0, 1.0, 0.0])], "y int, p array<double>")
    r = M.log_loss(df, F.col("y"), F.col("p")).first().log_loss
    assert abs(r - (-math.log(1 - 1e-15) - math.log(1e-15)) / 2) < 1e-9


def test_stratified_split_exact(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(1001)]
    df = spark.createDataFrame(rows, "id long, label int")
    s = MD.stratified_split(df, "label", ["id"], test_size=0.2, seed=42)
    counts = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    n_test = math.ceil(1001 * 0.2)
    assert counts[(0, "test")] + counts[(1, "test")] == n_test
    assert counts[(1, "test")] in (math.floor(334 * n_test / 1001), math.ceil(334 * n_test / 1001))
    again = {r.id for r in MD.stratified_split(df, "label", ["id"], 0.2, 42).where(F.col("split") == "test").collect()}
    first = {r.id for r in s.where(F.col("split") == "test").collect()}
    assert again == first  # deterministic in its seed


def test_unknown_estimator_raises():
    with pytest.raises(ValueError):
        MD.build_estimator(ModelConfig(estimator="svm"))


def test_text_scorer_sign_rule(spark):
    from mktlens.sources.stubs import stub_model_factory

    df = spark.createDataFrame([(1, "the cat"), (2, "moment"), (3, "nation"), (4, "xyz")], "id long, text string")
    out = {r.id: r.sentiment_score for r in MD.text_scorer(df, "text", stub_model_factory, 2).collect()}
    assert out == {1: 0.9, 2: -0.8, 3: 0.0, 4: 0.0}  # '5 stars' never matches after upper-casing


def test_summariser_fallback(spark):
    df = spark.createDataFrame([(1, "One. Two. Three. Four."), (2, "...")], "id long, text string")
    out = {r.id: r.summary for r in MD.summariser(df.select("id", F.array("text").alias("docs")), "docs").collect()}
    assert out[1] == "One. Two. Three." and out[2].startswith("Нет достаточной")


@pytest.mark.parametrize("estimator,params", [("random_forest", {"n_estimators": 5, "max_depth": 3}), ("logistic_regression", {"C": 0.5})])
def test_train_scores_holdout(spark, estimator, params):
    """Estimators that keep a training summary still score the hold-out (the
    fitted pipeline is reloaded before scoring) and report one metrics row."""
    rows = [(f"T{i % 3}", i, float(i % 7), float((i * 5) % 11), i % 2) for i in range(200)]
    d = spark.createDataFrame(rows, "ticker string, date int, a double, b double, target_direction int")
    cfg = ModelConfig(estimator=estimator, test_size=0.2, random_state=42, params=params)
    _, scored, rep = MD.train(d, ["a", "b"], cfg)
    assert scored.count() == 40
    assert rep.count() == 1
