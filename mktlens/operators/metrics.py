"""Evaluation metrics as aggregates.

All metrics are conditional sums / counts reduced by Spark's partial
aggregation; none collects predictions to the driver.  ROC-AUC is exact with
tie-averaged ranks: scores are reduced to (score, #pos, #neg) and the number of
negatives ranked below each score comes from a distributed prefix sum.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktlens.functions.exprs import col
from mktlens.operators.prefix import ordered_prefix_sums

EPS = 1e-15  # log-loss clipping of the reference


def base_rates(df: DataFrame, key: str = "ticker", target: str = "target_direction",
               macro_name: str = "macro_baseline") -> DataFrame:
    """Per-key mean of the target plus the unweighted mean of those rates."""
    per = df.groupBy(key).agg(F.avg(F.col(target).cast("double")).alias("score"))
    macro = per.agg(F.avg("score").alias("score")).select(F.lit(macro_name).alias(key), "score")
    return per.unionByName(macro)


def class_counts(df: DataFrame, label: str = "y") -> DataFrame:
    """A10."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """weight = majority count / own count."""
    c = class_counts(df, label)
    mx = c.agg(F.max("count").alias("_mx"))  # one row
    return c.crossJoin(F.broadcast(mx)).select(label, "count", (F.col("_mx") / F.col("count")).alias("weight"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: list[int]) -> DataFrame:
    """rows = truth, one column pred_<k> per class (zero filled)."""
    p = df.groupBy(truth).pivot(pred, classes).agg(F.count(F.lit(1)))
    return p.select(truth, *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"pred_{k}") for k in classes])


def binary_report(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """Accuracy and precision / recall / F1 of class 1, zero division -> 0."""
    t, p = truth.cast("int"), pred.cast("int")
    s = df.select(t.alias("t"), p.alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("t") == F.col("p"), 1).otherwise(0)).alias("correct"),
        F.sum(F.when((F.col("t") == 1) & (F.col("p") == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("t") == 0) & (F.col("p") == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("t") == 1) & (F.col("p") == 0), 1).otherwise(0)).alias("fn"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return s.select(
        ratio(F.col("correct"), F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_up"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_up"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_up"),
    )


def roc_auc(df: DataFrame, truth: Column, score: Column, n_parts: int | None = None) -> DataFrame:
    """Exact ROC-AUC, ties counted one half (Mann-Whitney); NULL where only one
    class is there."""
    per = df.select(truth.cast("int").alias("t"), score.cast("double").alias("s")).groupBy("s").agg(
        F.sum("t").cast("long").alias("pos"), F.sum(1 - F.col("t")).cast("long").alias("neg")
    )
    pre = ordered_prefix_sums(per, ["s"], ["neg"], n_parts)
    return pre.agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))), F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("roc_auc")
    )


def log_loss(df: DataFrame, truth: Column, probs: Column, eps: float = EPS) -> DataFrame:
    """Mean -ln(p[true class]) with probabilities clipped to [eps, 1-eps]."""
    p = F.element_at(probs, truth.cast("int") + 1)
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.ln(clipped)).alias("log_loss"))


def histogram(df: DataFrame, value: str | Column, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Fixed-width histogram over each group's [min, max]; the last bin
    is closed on the right (T25); a constant group spans [v-0.5, v+0.5]."""
    by = by or []
    v = df.select(*by, col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    rng = v.groupBy(*by).agg(F.min("v").alias("lo0"), F.max("v").alias("hi0"))
    rng = rng.select(
        *by,
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    # one row per group, of which there may be many; without groups one row
    j = v.join(rng, by) if by else v.crossJoin(F.broadcast(rng))
    b = F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))), F.lit(bins - 1))
    counts = j.groupBy(*by, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, by + ["bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
    )


def argmax_class(probs: str | Column) -> Column:
    """0-based index of the largest probability (first on ties)."""
    p = col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def class_probabilities(score: str | Column) -> Column:
    """Three-class probability vector used by the fixtures:
    [(1-p)/2, p, (1-p)/2]."""
    s = col(score)
    return F.array((1 - s) / 2, s, (1 - s) / 2)


def split_metrics(df: DataFrame, split: str, truth: str, probs: str, classes: list[int]) -> DataFrame:
    """Per split, log loss and the confusion counts (long form)."""
    pred = argmax_class(probs)
    p = F.element_at(F.col(probs), F.col(truth).cast("int") + 1)
    clipped = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    ll = df.groupBy(split).agg(F.avg(-F.ln(clipped)).alias("log_loss"), F.count(F.lit(1)).alias("n"))
    cm = df.groupBy(split, F.col(truth).alias("truth"), pred.alias("pred")).agg(F.count(F.lit(1)).alias("count"))
    return cm.join(ll, split)

