"""Model operators (M1-M15, S8, S9) on Spark ML.

* M1 is an exact stratified hold-out: test size ceil(n * test_size) split over
  labels by largest remainder, rows drawn by a seeded hash order.  The k
  smallest hashes of a label are found from per-bucket counts (top 16 hash
  bits) and an exact ranking only inside the one boundary bucket, so no task
  ever sorts a whole label.
* Fitting is Spark ML (tree-level / iteration-level distributed jobs).
* Scoring hooks (M14, M15) run a user model factory once per task over Arrow
  batches; the sign rule and fallbacks stay native.
"""
from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from mktlens.config import ModelConfig
from mktlens.functions.sentiment import signed_confidence
from mktlens.functions.text import SUMMARY_EMPTY_INPUT, extractive_summary, join_docs, summarise_docs
from mktlens.operators.metrics import binary_report, roc_auc
from mktlens.operators.scoring import score
from mktlens.session import cut_lineage, ensure_checkpoint_dir

HASH_BUCKET_BITS = 16


# ---------------------------------------------------------------- M1 / M2
def label_quotas(counts: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows per label: ceil(n*test) split by largest remainder (ties by
    label).  ``counts``: (label, count) — one row per class."""
    tot = counts.agg(F.sum("count").alias("n"))
    c = counts.crossJoin(F.broadcast(tot))
    n_test = F.ceil(F.col("n") * F.lit(test_size))
    exact = F.col("count") * n_test / F.col("n")
    c = c.withColumn("_n_test", n_test).withColumn("_base", F.floor(exact)).withColumn("_rem", exact - F.floor(exact))
    left = F.col("_n_test") - F.sum("_base").over(Window.partitionBy())
    w = Window.orderBy(F.col("_rem").desc(), F.col(label))
    c = c.withColumn("_k", F.row_number().over(w)).withColumn("_left", left)
    return c.select(label, "count", (F.col("_base") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified_split(df: DataFrame, label: str, keys: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """M1: adds ``split`` in {'train','test'} with exact per-label test sizes.  Rows are
    drawn in the order of the first 60 bits of the MD5 of seed and keys as text, a
    number that other engines can recompute, then of the keys."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    d = df.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).withColumn("_b", F.shiftright("_h", 60 - HASH_BUCKET_BITS))
    counts = d.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    quotas = label_quotas(counts, label, test_size)  # one row per class
    bc = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(label).orderBy("_b")
    bc = bc.withColumn("_before", F.coalesce(F.sum("_c").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bc = bc.join(F.broadcast(quotas.select(label, "quota")), label)
    # bucket status: all test, all train, or the boundary bucket.
    bc = bc.withColumn(
        "_state",
        F.when(F.col("_before") + F.col("_c") <= F.col("quota"), F.lit("test"))
        .when(F.col("_before") >= F.col("quota"), F.lit("train"))
        .otherwise(F.lit("edge")),
    ).select(label, "_b", "_before", "quota", "_state")
    j = d.join(bc, [label, "_b"])
    edge = j.where(F.col("_state") == "edge")
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", *keys))
    edge = edge.withColumn("_state", F.when(F.col("_before") + rank <= F.col("quota"), F.lit("test")).otherwise(F.lit("train")))
    out = j.where(F.col("_state") != "edge").unionByName(edge)
    return out.withColumnRenamed("_state", "split").drop("_h", "_b", "_before", "quota")


def hash_split(df: DataFrame, keys: list[str], test_fraction: float = 0.33, seed: int = 42) -> DataFrame:
    """M2: deterministic seeded hold-out by a hash threshold: the first 48 bits of
    the MD5 of seed and keys as text, a number that other engines can recompute."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return df.withColumn("split", F.when(u < test_fraction, F.lit("test")).otherwise(F.lit("train")))


# ---------------------------------------------------------------- M3-M7
def assembler_scaler(features: list[str], out: str = "features") -> list:
    """M3: VectorAssembler + StandardScaler(withMean=True).  Spark divides by
    the sample std; ``rescale_population`` turns the output into the
    n-divisor scaling of the reference library when exactness is wanted."""
    va = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep")
    sc = StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True)
    return [va, sc]


def rescale_population(df: DataFrame, col: str, n_rows: int) -> DataFrame:
    """Scaled vectors divided by the population instead of the sample std."""
    from pyspark.ml.functions import array_to_vector

    k = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    return df.withColumn(col, array_to_vector(F.transform(vector_to_array(col), lambda x: x * k)))


def scaler_moments(df: DataFrame, features: list[str]) -> list[tuple[str, float, float]]:
    """M3 fitted moments (mean, sample std) per feature — a vector of the
    fitted model, one entry per feature."""
    va, sc = assembler_scaler(features, "_scaled")
    m = Pipeline(stages=[va, sc]).fit(df).stages[-1]
    return [(f, float(a), float(b)) for f, a, b in zip(features, m.mean.toArray(), m.std.toArray())]


# The parameters that each estimator takes.
PARAMETERS = {
    "random_forest": {"n_estimators", "max_depth"},
    "gradient_boosting": {"n_estimators", "max_depth", "learning_rate"},
    "logistic_regression": {"C"},
}


def build_estimator(cfg: ModelConfig, n_rows: int | None = None, features_col: str = "features", label_col: str = "label"):
    """M7: estimator by name (M4-M6); unknown names and parameters are an error.

    A forest without a depth limit (``max_depth`` absent or None) gets 30, the
    deepest tree that Spark ML builds."""
    name = cfg.estimator.lower()
    p = dict(cfg.params or {})
    if unknown := set(p) - PARAMETERS.get(name, set(p)):
        raise ValueError(f"Unsupported parameters of '{cfg.estimator}': {', '.join(sorted(unknown))}")
    if name == "random_forest":
        return RandomForestClassifier(
            featuresCol=features_col, labelCol=label_col, seed=cfg.random_state,
            numTrees=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth") or 30),
        )
    if name == "gradient_boosting":
        return GBTClassifier(
            featuresCol=features_col, labelCol=label_col, seed=cfg.random_state,
            maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 3)), stepSize=float(p.get("learning_rate", 0.1)),
        )
    if name == "logistic_regression":
        c = float(p.get("C", 1.0))
        reg = 1.0 / (max(n_rows or 1, 1) * c)
        return LogisticRegression(
            featuresCol=features_col, labelCol=label_col, maxIter=1000, regParam=reg, elasticNetParam=0.0, standardization=False,
            tol=1e-4,
        )
    raise ValueError(f"Unsupported estimator '{cfg.estimator}'")


def estimator_stages(features: list[str], cfg: ModelConfig, n_rows: int | None = None) -> Pipeline:
    return Pipeline(stages=assembler_scaler(features) + [build_estimator(cfg, n_rows)])


def prob_up(prediction: DataFrame, out: str = "probability_up") -> DataFrame:
    """Probability of class 1 from the ML probability vector."""
    return prediction.withColumn(out, vector_to_array("probability")[1])


def detach(model: PipelineModel, spark) -> PipelineModel:
    """Save a fitted pipeline to the shared checkpoint folder and load it back.
    Fitted classifiers keep a training summary that refers to the session,
    which cannot be shipped to executors; the reloaded model has no summary,
    and the saved copy survives the loss of the driver's in-memory state."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/mktlens-models/{uuid.uuid4().hex[:12]}"
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


# ---------------------------------------------------------------- M8
def prepare(dataset: DataFrame, cfg: ModelConfig = ModelConfig(), keys=("ticker", "date"), target: str = "target_direction") -> DataFrame:
    """The rows of a training run with their ``label`` and ``split``, stored: runs that
    share test size and seed share them.  Raises when a class has fewer than 2 rows (as
    the reference split does)."""
    # The class check and the split read the rows several times, and several jobs read
    # the split (count, fit passes, scoring): cut the lineage of both once into the
    # shared checkpoint folder, so that the features are computed once.
    d = cut_lineage(dataset.withColumn("label", F.col(target).cast("double")))
    counts = d.groupBy("label").count()
    if counts.where(F.col("count") < 2).limit(1).count() > 0:
        raise ValueError("The least populated class in y has only 1 member")
    return cut_lineage(stratified_split(d, "label", list(keys), cfg.test_size, cfg.random_state))


def train_prepared(s: DataFrame, features: list[str], cfg: ModelConfig = ModelConfig()) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """``train`` on rows from ``prepare``."""
    tr, te = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    n = tr.count()
    model = detach(estimator_stages(features, cfg, n).fit(tr), s.sparkSession)
    scored = prob_up(model.transform(te))
    rep = binary_report(scored, F.col("label"), F.col("prediction"))
    auc = roc_auc(scored, F.col("label"), F.col("probability_up"))
    return model, scored, rep.crossJoin(auc)


def train(dataset: DataFrame, features: list[str], cfg: ModelConfig = ModelConfig(), keys=("ticker", "date"),
          target: str = "target_direction") -> tuple[PipelineModel, DataFrame, DataFrame]:
    """M8: stratified split -> fit -> predict hold-out -> metrics row.

    Returns (model, scored hold-out, metrics row).  Raises when a class has
    fewer than 2 rows (as the reference split does)."""
    return train_prepared(prepare(dataset, cfg, keys, target), features, cfg)


# ---------------------------------------------------------------- S8 / S9
def save_run(model: PipelineModel, metrics: DataFrame, root: str, estimator: str) -> str:
    """Model under a timestamped name + metrics row appended to a runs
    table (Spark commit protocol, no driver-side file juggling)."""
    ts = time.strftime("%Y%m%d%H%M%S", time.gmtime())
    path = f"{root.rstrip('/')}/models/{estimator}_{ts}_{uuid.uuid4().hex[:8]}"  # two runs may start in one second
    model.write().save(path)
    run = metrics.select(F.lit(path).alias("path"), F.lit(estimator).alias("estimator"), F.current_timestamp().alias("run_ts"), "*")
    run.write.mode("append").parquet(f"{root.rstrip('/')}/runs")
    return path


def latest_model_path(runs: DataFrame) -> DataFrame:
    """Newest artefact."""
    return runs.agg(F.max_by("path", "run_ts").alias("path"))


# ---------------------------------------------------------------- M9 / M10
def latest_rows(features: DataFrame, key: str = "ticker") -> DataFrame:
    """Latest row per key via max_by over a struct (no sort of series)."""
    cols = [c for c in features.columns if c != key]
    return features.groupBy(key).agg(F.max_by(F.struct(*cols), "date").alias("r")).select(key, "r.*")


def score_latest(model: PipelineModel | dict, features: DataFrame, columns: list[str], cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """M9 + M10: newest row per ticker -> model columns (P20) -> probability
    -> 2-way direction (P22) and 4-way band (P13).  ``model``: a fitted pipeline, or
    its export (``scoring``), which is scored by native expressions."""
    from mktlens.operators.features import model_matrix
    from mktlens.operators.report import direction_2way, signal_band

    latest = model_matrix(latest_rows(features), columns)
    scored = score(latest, model) if isinstance(model, dict) else prob_up(model.transform(latest))
    return scored.select(
        "ticker", "date", "close", "probability_up",
        direction_2way("probability_up").alias("direction"),
        signal_band("probability_up", cfg).alias("signal"),
    )


# ---------------------------------------------------------------- M11 (M12: forest.py)
def interval_tree(train_df: DataFrame, feature_cols: list[str], label: str = "label", depth: int = 10, seed: int = 42) -> PipelineModel:
    """Decision tree (depth 10) on interval statistics."""
    va = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    dt = DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=[va, dt]).fit(train_df)


# ---------------------------------------------------------------- M14 / M15
def text_scorer(df: DataFrame, text_col: str, model_factory: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
                batch_size: int = 16) -> DataFrame:
    """Batch text scorer hook.  ``model_factory`` is called once per task
    and returns a function texts -> [(label, confidence)]; texts go through it
    in batches of ``batch_size``.  The signed score uses the reference rule."""

    def run(batches):
        model = model_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            labels, confs = [], []
            for i in range(0, len(texts), batch_size):
                for lab, conf in model(texts[i:i + batch_size]):
                    labels.append(lab)
                    confs.append(float(conf))
            out = pdf.copy()
            out["model_label"] = pd.Series(labels, dtype="object", index=pdf.index)
            out["model_confidence"] = pd.Series(confs, dtype="float64", index=pdf.index)
            yield out

    schema = T.StructType(list(df.schema.fields) + [T.StructField("model_label", T.StringType()),
                                                    T.StructField("model_confidence", T.DoubleType())])
    scored = df.mapInPandas(run, schema=schema)
    return scored.withColumn("sentiment_score", signed_confidence("model_label", "model_confidence")).withColumn(
        "sentiment_label", F.col("model_label")
    )


def summariser(df: DataFrame, docs_col: str, model_factory: Callable[[], Callable[[list[str]], list[str | None]]] | None = None,
               model_name: str = "model", batch_size: int = 16) -> DataFrame:
    """The summary of an array of texts, joined and cut (F10), by a model.

    ``model_factory`` is called once per task and returns a function texts ->
    summaries.  Where there is no model, it gives NULL or nothing, or fails (a batch
    that fails is tried text by text), the extractive summary (F9) is taken and
    ``used_model`` is NULL, else ``model_name``.  Nothing to summarise: the default
    sentence, without the model.  Adds summary and used_model."""
    joined = df.withColumn("_joined", F.coalesce(join_docs(docs_col), F.lit("")))
    if model_factory is None:
        return joined.withColumn("summary", summarise_docs(docs_col)).withColumn("used_model", F.lit(None).cast("string")).drop("_joined")

    def attempt(fn, texts: list[str]) -> list[str | None]:
        try:
            found = list(fn(texts))
            if len(found) == len(texts):
                return found
        except Exception:  # a user's model may fail in any way; the row falls back
            pass
        return [None] if len(texts) == 1 else [x for t in texts for x in attempt(fn, [t])]

    @arrow_udf(T.StringType())
    def model(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = model_factory()
        for texts in batches:
            known = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            out, done = [pa.array([], pa.string())], 0
            for at in range(0, len(known), batch_size):
                part = known[at : at + batch_size]
                found: list[str | None] = [None] * (int(part[-1]) + 1 - done)
                for i, x in zip((part - done).tolist(), attempt(fn, texts.take(pa.array(part)).to_pylist())):
                    found[i] = x or None
                out.append(pa.array(found, pa.string()))
                done += len(found)
            yield pa.concat_arrays([*out, pa.nulls(len(texts) - done, pa.string())])

    # non-deterministic for Spark, so that it never runs the model twice; only the joined
    # texts go to Python, a model's batch of them as Python strings at a time
    s = joined.withColumn("_model", model.asNondeterministic()(F.col("_joined")))
    return s.withColumn("summary", F.coalesce("_model", F.when(F.col("_joined") == "", F.lit(SUMMARY_EMPTY_INPUT)).otherwise(extractive_summary("_joined")))).withColumn(
        "used_model", F.when(F.col("_model").isNotNull(), F.lit(model_name))
    ).drop("_model", "_joined")


def n_test_rows(n: int, test_size: float) -> int:
    return int(math.ceil(n * test_size))
