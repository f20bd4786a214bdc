"""Queries: splits, scaling, classifiers, scoring hooks, interval features
(M1-M15, F16, F19, S8, S9, S14).  Model outputs depend on Spark ML's own
random streams, so most are rows-only; everything SQL-expressible (split
sizes, scaler moments, interval statistics, the summariser fallback) has an
oracle."""
from __future__ import annotations

import os
import uuid
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mktlens.config import ModelConfig
from mktlens.functions import text as TX
from mktlens.operators import features as X
from mktlens.operators import forest as TF
from mktlens.operators import models as MD
from mktlens.operators import samples as S
from mktlens.operators import scoring as SC
from mktlens.operators.news import NEWS_FEATURE_COLUMNS
from mktlens.plans.q_features import annotated_news, x1_build_features
from mktlens.plans.q_metrics import X1_CTES
from mktlens.plans.q_report import SIGNAL_SQL, _joined_sql, _summary_sql
from mktlens.plans.q_windows import LABEL_CTES, SAMPLES_SQL, x10_window_samples
from mktlens.plans.registry import register, with_ctes
from mktlens.plans.sqlparts import feature_matrix_sql, news_aggregates_sql, price_features_sql
from mktlens.session import cut_lineage, ensure_checkpoint_dir
from mktlens.sources import fixtures as fx
from mktlens.sources.stubs import stub_model_factory, stub_summariser_factory

# Configured forest of the reference training config (fixed values).
TRAIN_CFG = ModelConfig(estimator="random_forest", test_size=0.2, random_state=42, params={"n_estimators": 200, "max_depth": 5})
SERIES_LEN = 64
INTERVALS = S.draw_intervals(SERIES_LEN, seed=42)


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/mktlens-scratch/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- M1 / M2
@register("M1_stratified_split", sql=with_ctes(*X1_CTES, """c AS (SELECT CAST(target_direction AS DOUBLE) AS label, count(*) AS count FROM x1 GROUP BY 1),
q0 AS (SELECT label, count, ceil(n * 0.2) AS n_test, count * ceil(n * 0.2) / n AS ex FROM c, (SELECT sum(count) AS n FROM c)),
q1 AS (SELECT label, count, floor(ex) AS base, ex - floor(ex) AS rem, n_test - sum(floor(ex)) OVER () AS lft,
              row_number() OVER (ORDER BY ex - floor(ex) DESC, label) AS k FROM q0),
q AS (SELECT label, count, CAST(base + CASE WHEN k <= lft THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q1),
drawn AS (SELECT ticker, date, CAST(target_direction AS DOUBLE) AS label, row_number() OVER (PARTITION BY target_direction
  ORDER BY CAST('0x' || substr(md5('42|' || ticker || '|' || strftime(date, '%Y-%m-%d')), 1, 15) AS BIGINT), ticker, date) AS place FROM x1)""",
    body="SELECT ticker, date, label, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split FROM drawn JOIN q USING (label)"))
def m1_stratified_split(spark, sf_dir):
    """Exact stratified hold-out (20 %, seed 42): the split of every row."""
    d = x1_build_features(spark, sf_dir).withColumn("label", F.col("target_direction").cast("double"))
    return MD.stratified_split(d, "label", ["ticker", "date"], 0.2, 42).select("ticker", "date", "label", "split")


@register("M2_hash_split", sql=with_ctes(*LABEL_CTES, SAMPLES_SQL, body="""SELECT ticker, window_no,
  CASE WHEN CAST('0x' || substr(md5('42|' || ticker || '|' || window_no), 1, 12) AS BIGINT) / 281474976710656.0 < 0.33 THEN 'test' ELSE 'train' END AS split
FROM samples"""))
def m2_hash_split(spark, sf_dir):
    """Seeded hash hold-out of 0.33 over the window samples."""
    s = MD.hash_split(x10_window_samples(spark, sf_dir), ["ticker", "window_no"], 0.33, 42)
    return s.select("ticker", "window_no", "split")


# ---------------------------------------------------------------- M3
@register("M3_standardise", sql=with_ctes(*X1_CTES, "u AS (UNPIVOT (SELECT " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in X.MODEL_FEATURES) + " FROM x1) ON " + ", ".join(X.MODEL_FEATURES) + " INTO NAME feature VALUE v)",
    body="SELECT feature, avg(v) AS mean, stddev_samp(v) AS std FROM u GROUP BY feature"), dbl=("mean", "std"))
def m3_standardise(spark, sf_dir):
    """Scaler moments (mean, sample std) fitted over the feature matrix."""
    mom = MD.scaler_moments(x1_build_features(spark, sf_dir), X.MODEL_FEATURES)
    return spark.createDataFrame(mom, "feature string, mean double, std double")


# ---------------------------------------------------------------- M4-M8
def _stored_bars(spark, sf_dir):
    """The bars, a row per ticker and day, computed once: their positions and windows
    (and a query's other features) read them several times."""
    return cut_lineage(fx.bars(spark, sf_dir))


def _train(spark, sf_dir, cfg):
    return MD.train(X.build_features(_stored_bars(spark, sf_dir), annotated_news(spark, sf_dir)), X.MODEL_FEATURES, cfg)


@register("M4_random_forest")
def m4_random_forest(spark, sf_dir):
    """Random forest (200 trees, depth 5): hold-out metrics row."""
    return _train(spark, sf_dir, TRAIN_CFG)[2]


@register("M5_gradient_boosting")
def m5_gradient_boosting(spark, sf_dir):
    """Gradient-boosted trees (100 rounds): hold-out metrics row."""
    return _train(spark, sf_dir, ModelConfig(estimator="gradient_boosting", params={"n_estimators": 100, "max_depth": 3}))[2]


@register("M6_logistic_regression")
def m6_logistic_regression(spark, sf_dir):
    """Logistic regression (L2, C=1 as regParam 1/(n C)): hold-out metrics row."""
    return _train(spark, sf_dir, ModelConfig(estimator="logistic_regression"))[2]


@register("M7_estimator_choice")
def m7_estimator_choice(spark, sf_dir):
    """Estimator chosen by its configured name (unknown names raise), fitted
    on the feature matrix: Spark class and hold-out metrics."""
    cfg = ModelConfig(estimator="logistic_regression")
    cls = type(MD.build_estimator(cfg, 1)).__name__
    return _train(spark, sf_dir, cfg)[2].select(F.lit(cfg.estimator).alias("estimator"), F.lit(cls).alias("spark_class"), "*")


@register("M8_train")
def m8_train(spark, sf_dir):
    """Training run with the configured estimator: accuracy, precision/recall/F1 up, ROC-AUC."""
    return _train(spark, sf_dir, TRAIN_CFG)[2]


# Models fitted by tools/export_model.py on the feature matrix, as saved for scoring.
HERE = os.path.dirname(os.path.abspath(__file__))
SAVED_LOGISTIC = SC.load(f"{HERE}/saved_logistic.json")
SAVED_FOREST = SC.load(f"{HERE}/saved_forest.json")
LIST_SUM = "list_reduce([0E0, {0}], lambda a, x: a + x)"

M9_SQL = with_ctes(fx.BARS_SQL, price_features_sql(), "latest AS (SELECT *, " + ", ".join(
    f"0 AS {c}" for c in NEWS_FEATURE_COLUMNS if c in X.MODEL_FEATURES) + " FROM price QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)",
    body=f"""SELECT ticker, date, close, probability_up, CASE WHEN probability_up >= 0.5 THEN 'up' ELSE 'down' END AS direction
FROM (SELECT ticker, date, close, {SC.probability_sql(SAVED_LOGISTIC, LIST_SUM)} AS probability_up FROM latest)""")


@register("M9_latest_prediction", sql=M9_SQL, dbl=("close", "probability_up"))
def m9_latest_prediction(spark, sf_dir):
    """Newest row per ticker scored by a saved logistic regression as an expression: probability and direction."""
    feats = X.build_features_for_inference(fx.bars(spark, sf_dir), None)
    return MD.score_latest(SAVED_LOGISTIC, feats, X.MODEL_FEATURES).select("ticker", "date", "close", "probability_up", "direction")


M10_SQL = with_ctes(fx.BARS_SQL, fx.NEWS_SQL, fx.ANNOTATED_SQL, price_features_sql(), news_aggregates_sql(), "x2 AS (" + feature_matrix_sql(train=False) + ")",
                    body=f"""SELECT ticker, p AS probability_up, {SIGNAL_SQL} AS signal
FROM (SELECT ticker, {SC.probability_sql(SAVED_FOREST, LIST_SUM)} AS p FROM x2 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)""")


@register("M10_score_probability", sql=M10_SQL, dbl=("probability_up",))
def m10_score_probability(spark, sf_dir):
    """Probability of a saved forest + four-way band for the latest inference row per ticker."""
    feats = X.build_features_for_inference(fx.bars(spark, sf_dir), annotated_news(spark, sf_dir))
    return MD.score_latest(SAVED_FOREST, feats, X.MODEL_FEATURES).select("ticker", "probability_up", "signal")


@register("M10_fitted_expressions")
def m10_fitted_expressions(spark, sf_dir):
    """A regression fitted on the feature matrix, then the newest rows scored by the pipeline and by its expression."""
    merged = cut_lineage(X.merge_features(_stored_bars(spark, sf_dir), annotated_news(spark, sf_dir)))  # to train on and to score
    model, _, _ = MD.train(X.training_rows(merged), X.MODEL_FEATURES, ModelConfig(estimator="logistic_regression"))
    latest = X.model_matrix(MD.latest_rows(X.fill_numeric(merged)), X.MODEL_FEATURES)
    scored = MD.prob_up(model.transform(latest), "by_pipeline").drop("features", "_raw", "rawPrediction", "probability", "prediction")
    return SC.score(scored, SC.export(model), "by_expression").select("ticker", "date", "by_pipeline", "by_expression")


# ---------------------------------------------------------------- F16 / F19 / M11 / M12
def _f16_sql() -> str:
    cols = []
    for k, (a, b) in enumerate(INTERVALS):
        sl = f"list_slice(v, {a + 1}, {b})"
        n = f"CAST(len({sl}) AS DOUBLE)"
        mean = f"(list_reduce({sl}, lambda s, x: s + x) / len({sl}))"
        std = f"sqrt(list_reduce(list_transform({sl}, lambda x: (x - {mean}) * (x - {mean})), lambda s, x: s + x) / len({sl}))"
        sx = f"(({n} * ({n} - 1)) / 2.0)"
        sxx = f"(({n} - 1) * {n} * (2 * {n} - 1) / 6.0)"
        sxy = f"list_reduce(list_transform(range(0, len({sl})), lambda i: i * {sl}[i + 1]), lambda s, x: s + x)"
        den = f"({n} * {sxx} - {sx} * {sx})"
        slope = f"CASE WHEN {den} <> 0 THEN ({n} * {sxy} - {sx} * list_reduce({sl}, lambda s, x: s + x)) / {den} ELSE 0.0 END"
        cols += [f"{mean} AS i{k}_mean", f"{std} AS i{k}_std", f"{slope} AS i{k}_slope"]
    return ("SELECT vec_id, label, " + ", ".join(cols) +
            " FROM (SELECT vec_id, CAST(label AS INTEGER) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)")


F16_DBL = tuple(f"i{k}_{s}" for k in range(len(INTERVALS)) for s in ("mean", "std", "slope"))


def _interval_frame(spark, sf_dir):
    return S.interval_features(fx.series(spark, sf_dir), "values", INTERVALS).drop("values")


@register("F16_interval_features", sql=_f16_sql(), dbl=F16_DBL)
def f16_interval_features(spark, sf_dir):
    """Mean, std and slope over seeded random intervals of each series."""
    return _interval_frame(spark, sf_dir)


@register("F19_series_vector", sql="SELECT vec_id, CAST(label AS INTEGER) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features FROM embeddings",
          arr=("features",))
def f19_series_vector(spark, sf_dir):
    """Series as fixed-shape ML vectors (their values)."""
    v = S.to_vector(fx.series(spark, sf_dir), "values", "features")
    return v.select("vec_id", "label", vector_to_array("features").alias("features"))


def _interval_split(spark, sf_dir):
    f = _interval_frame(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    return MD.hash_split(f, ["vec_id"], 0.33, 42)


@register("M11_interval_tree")
def m11_interval_tree(spark, sf_dir):
    """Depth-10 decision tree on interval statistics: predictions of both splits."""
    s = _interval_split(spark, sf_dir)
    m = MD.interval_tree(s.where(F.col("split") == "train"), list(F16_DBL), "label", 10)
    return m.transform(s).select("vec_id", "split", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@lru_cache(maxsize=1)
def _forest(spark, sf_dir):
    """(series with their split, a forest of 100 trees fitted on the training part)."""
    s = MD.hash_split(fx.series(spark, sf_dir), ["vec_id"], 0.33, 42)
    return s, TF.fit(s.where(F.col("split") == "train"), "values", "label", trees=100)


@register("M12_interval_forest")
def m12_interval_forest(spark, sf_dir):
    """Time-series forest (100 trees, each on intervals of its own): hold-out predictions and probabilities."""
    s, forest = _forest(spark, sf_dir)
    p = TF.predict(s.where(F.col("split") == "test"), forest)
    return p.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "probabilities")


@register("M12_forest_importances")
def m12_forest_importances(spark, sf_dir):
    """Importances of the same forest by tree, interval and statistic."""
    return TF.importances(spark, _forest(spark, sf_dir)[1])


@register("M12_temporal_importances")
def m12_temporal_importances(spark, sf_dir):
    """Importances of the same forest by statistic and point of time."""
    forest = _forest(spark, sf_dir)[1]
    return TF.temporal_importances(TF.importances(spark, forest), forest.length)


# ---------------------------------------------------------------- S14
@register("S14_ucr_reader", sql="SELECT CAST(label AS INTEGER) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS \"values\" FROM embeddings",
          arr=("values",))
def s14_ucr_reader(spark, sf_dir):
    """Series written as a tab-separated file and read back (label, values)."""
    from mktlens.sources.readers import read_ucr

    path = scratch(spark, "ucr")
    s = fx.series(spark, sf_dir)
    line = F.concat_ws("\t", F.col("label").cast("string"), F.array_join(F.transform("values", lambda x: x.cast("string")), "\t"))
    s.select(line.alias("value")).write.mode("overwrite").text(path)
    return read_ucr(spark, path)


# ---------------------------------------------------------------- M14 / M15
@register("M14_text_scorer", sql="""SELECT doc_id, model_label, model_confidence,
  CASE upper(model_label) WHEN 'POSITIVE' THEN model_confidence WHEN 'NEGATIVE' THEN -model_confidence ELSE 0.0 END AS sentiment_score
FROM (SELECT doc_id, CASE WHEN t AND NOT e THEN 'POSITIVE' WHEN e AND NOT t THEN 'negative' WHEN n THEN '5 stars' ELSE 'neutral' END AS model_label,
             CAST(CASE WHEN t AND NOT e THEN 0.9 WHEN e AND NOT t THEN 0.8 WHEN n THEN 0.7 ELSE 0.6 END AS DOUBLE) AS model_confidence
      FROM (SELECT doc_id, instr(lower(text), 'the') > 0 AS t, instr(lower(text), 'ent') > 0 AS e, instr(lower(text), 'tion') > 0 AS n FROM documents))""",
          dbl=("model_confidence", "sentiment_score"))
def m14_text_scorer(spark, sf_dir):
    """Batch text scorer hook (batches of 16) with the signed-confidence rule."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return MD.text_scorer(d, "text", stub_model_factory, 16).select("doc_id", "model_label", "model_confidence", "sentiment_score")


M15_JOINED = _joined_sql("[text]")


@register("M15_summariser", sql=f"""SELECT doc_id, CASE WHEN j = '' THEN '{TX.SUMMARY_EMPTY_INPUT}' WHEN length(j) % 5 > 2 THEN length(j) || ': ' || substr(j, 1, 60) ELSE {_summary_sql('j')} END AS summary,
  CASE WHEN j <> '' AND length(j) % 5 > 2 THEN 'stub' END AS used_model FROM (SELECT doc_id, coalesce({M15_JOINED}, '') AS j FROM documents)""")
def m15_summariser(spark, sf_dir):
    """Summariser hook over whole documents: the model's text, or the extractive summary where it fails or gives nothing."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.array("text").alias("docs"))
    return MD.summariser(d, "docs", stub_summariser_factory, "stub").select("doc_id", "summary", "used_model")


# ---------------------------------------------------------------- S8 / S9
@register("S8_persist_run")
def s8_persist_run(spark, sf_dir):
    """Model saved under a timestamped name, metrics appended to a runs table."""
    cfg = ModelConfig(estimator="logistic_regression")
    model, _, metrics = _train(spark, sf_dir, cfg)
    root = scratch(spark, "runs")
    MD.save_run(model, metrics, root, cfg.estimator)
    return spark.read.parquet(f"{root}/runs").drop("run_ts", "path")


@register("S9_latest_model")
def s9_latest_model(spark, sf_dir):
    """Of two saved runs the newer model, reloaded: the newest row per ticker scored by it."""
    root = scratch(spark, "runs")
    paths = []
    bars = _stored_bars(spark, sf_dir)
    split = MD.prepare(X.build_features(bars, annotated_news(spark, sf_dir)))  # one for both runs
    for c in (0.1, 1.0):
        cfg = ModelConfig(estimator="logistic_regression", params={"C": c})
        model, _, metrics = MD.train_prepared(split, X.MODEL_FEATURES, cfg)
        paths.append(MD.save_run(model, metrics, root, cfg.estimator))
    path = MD.latest_model_path(spark.read.parquet(f"{root}/runs")).first()["path"]
    if path != paths[-1]:
        raise RuntimeError("the newest run is not the last one")
    feats = X.build_features_for_inference(bars, None)
    return MD.score_latest(PipelineModel.load(path), feats, X.MODEL_FEATURES)
