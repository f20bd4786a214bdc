"""Queries: evaluation metrics over the scores fixture and the feature matrix
(A7, A10-A16, A18, F17, M13 metrics part)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mktlens.operators import metrics as M
from mktlens.operators import sketches as SK
from mktlens.plans.q_features import x1_build_features
from mktlens.plans.registry import register, with_ctes
from mktlens.plans.sqlparts import feature_matrix_sql, news_aggregates_sql, price_features_sql
from mktlens.session import ensure_checkpoint_dir
from mktlens.sources import fixtures as fx

X1_CTES = (fx.BARS_SQL, fx.NEWS_SQL, fx.ANNOTATED_SQL, price_features_sql(), news_aggregates_sql(),
           "x1 AS (" + feature_matrix_sql(train=True) + ")")

# Fixture prediction rule for the three classes (score thresholds).
PRED_SQL = "CASE WHEN p < 0.35 THEN 0 WHEN p < 0.65 THEN 1 ELSE 2 END"


def _pred(p):
    return F.when(p < 0.35, 0).when(p < 0.65, 1).otherwise(2)


@register("A7_base_rates", sql=with_ctes(*X1_CTES, body="""SELECT ticker, score FROM (
  SELECT ticker, avg(CAST(target_direction AS DOUBLE)) AS score FROM x1 GROUP BY ticker)
UNION ALL
SELECT 'macro_baseline' AS ticker, avg(score) AS score FROM (
  SELECT ticker, avg(CAST(target_direction AS DOUBLE)) AS score FROM x1 GROUP BY ticker)"""), dbl=("score",))
def a7_base_rates(spark, sf_dir):
    """Per-ticker base rate of target_direction and their macro mean."""
    return M.base_rates(x1_build_features(spark, sf_dir))


@register("A10_class_counts", sql=with_ctes(fx.SCORES_SQL, body="SELECT y, count(*) AS count FROM scores GROUP BY y"))
def a10_class_counts(spark, sf_dir):
    """Class counts."""
    return M.class_counts(fx.scores(spark, sf_dir), "y")


@register("A11_class_weights", sql=with_ctes(fx.SCORES_SQL, body="""SELECT y, count, (SELECT max(c) FROM (SELECT count(*) AS c FROM scores GROUP BY y)) / count AS weight
FROM (SELECT y, count(*) AS count FROM scores GROUP BY y)"""), dbl=("weight",))
def a11_class_weights(spark, sf_dir):
    """Class weight = majority count / own count."""
    return M.class_weights(fx.scores(spark, sf_dir), "y")


@register("A12_confusion_matrix", sql=with_ctes(fx.SCORES_SQL, body=f"""SELECT y,
  count(*) FILTER (WHERE {PRED_SQL} = 0) AS pred_0,
  count(*) FILTER (WHERE {PRED_SQL} = 1) AS pred_1,
  count(*) FILTER (WHERE {PRED_SQL} = 2) AS pred_2
FROM scores GROUP BY y"""))
def a12_confusion_matrix(spark, sf_dir):
    """3-class confusion matrix (truth rows x predicted columns)."""
    s = fx.scores(spark, sf_dir).withColumn("pred", _pred(F.col("p")))
    return M.confusion_matrix(s, "y", "pred", [0, 1, 2])


@register("A13_binary_report", sql=with_ctes(fx.SCORES_SQL, body="""SELECT
  coalesce(correct / nullif(n, 0), 0.0) AS accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision_up,
  coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall_up,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1_up
FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
             CAST(count(*) FILTER (WHERE t = pr) AS DOUBLE) AS correct,
             CAST(count(*) FILTER (WHERE t = 1 AND pr = 1) AS DOUBLE) AS tp,
             CAST(count(*) FILTER (WHERE t = 0 AND pr = 1) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (WHERE t = 1 AND pr = 0) AS DOUBLE) AS fn
      FROM (SELECT CAST(y = 1 AS INTEGER) AS t, CAST(p >= 0.5 AS INTEGER) AS pr FROM scores))"""),
    dbl=("accuracy", "precision_up", "recall_up", "f1_up"))
def a13_binary_report(spark, sf_dir):
    """Accuracy, precision / recall / F1 of class 1 (truth y = 1, prediction p >= 0.5)."""
    s = fx.scores(spark, sf_dir)
    return M.binary_report(s, F.col("y") == 1, F.col("p") >= 0.5)


@register("A14_roc_auc", sql=with_ctes(fx.SCORES_SQL, body="""SELECT (sum(r) FILTER (WHERE t = 1) - npos * (npos + 1) / 2.0) / (npos * nneg) AS roc_auc
FROM (SELECT t, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r,
             CAST(sum(t) OVER () AS DOUBLE) AS npos, CAST(sum(1 - t) OVER () AS DOUBLE) AS nneg
      FROM (SELECT CAST(y = 1 AS INTEGER) AS t, p FROM scores))
GROUP BY npos, nneg"""), dbl=("roc_auc",), bench=True)
def a14_roc_auc(spark, sf_dir):
    """Exact ROC-AUC (truth y = 1 vs score p), ties averaged."""
    s = fx.scores(spark, sf_dir)
    return M.roc_auc(s, F.col("y") == 1, F.col("p"))


@register("A15_log_loss", sql=with_ctes(fx.SCORES_SQL, body="""SELECT avg(-ln(least(greatest(pt, 1e-15), 1 - 1e-15))) AS log_loss
FROM (SELECT CASE y WHEN 1 THEN p ELSE (1 - p) / 2 END AS pt FROM scores)"""), dbl=("log_loss",))
def a15_log_loss(spark, sf_dir):
    """Log loss of the 3-class vector [(1-p)/2, p, (1-p)/2] with 1e-15 clipping."""
    s = fx.scores(spark, sf_dir)
    return M.log_loss(s, F.col("y"), M.class_probabilities("p"))


def _hist_sql(src: str, value: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""v AS (SELECT {g}CAST({value} AS DOUBLE) AS v FROM {src} WHERE {value} IS NOT NULL),
rng AS (SELECT {g}CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                 CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v {gb}),
cnt AS (SELECT {g}CAST(least(floor((v - lo) * (10.0 / (hi - lo))), 9) AS INTEGER) AS bin, count(*) AS count
        FROM v JOIN rng {on} GROUP BY ALL),
grid AS (SELECT {g}lo, hi, CAST(unnest(range(0, 10)) AS INTEGER) AS bin FROM rng)"""


@register("A16_probability_histogram", sql=with_ctes(fx.SCORES_SQL, _hist_sql("scores", "p", "y"), body="""SELECT y, bin,
  lo + bin * ((hi - lo) / 10) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 10) AS bin_hi, coalesce(count, 0) AS count
FROM grid LEFT JOIN cnt USING (y, bin)"""), dbl=("bin_lo", "bin_hi"))
def a16_probability_histogram(spark, sf_dir):
    """10-bin histogram of the score by true class (last bin closed)."""
    return M.histogram(fx.scores(spark, sf_dir), "p", ["y"], 10)


@register("A16_close_histogram", sql=with_ctes(fx.BARS_SQL, _hist_sql("bars", "close", None), body="""SELECT bin,
  lo + bin * ((hi - lo) / 10) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 10) AS bin_hi, coalesce(count, 0) AS count
FROM grid LEFT JOIN cnt USING (bin)"""), dbl=("bin_lo", "bin_hi"))
def a16_close_histogram(spark, sf_dir):
    """10-bin histogram of closes."""
    return M.histogram(fx.bars(spark, sf_dir), "close", None, 10)


@register("A18_distinct_tickers", sql=with_ctes(fx.BARS_SQL, body="SELECT count(DISTINCT ticker) AS n_tickers FROM bars"))
def a18_distinct_tickers(spark, sf_dir):
    """Distinct ticker count."""
    return fx.bars(spark, sf_dir).agg(F.countDistinct("ticker").alias("n_tickers"))


@register("A18_distinct_sketches", sql=with_ctes(fx.NEWS_SQL, body="""SELECT coalesce(strftime(date, '%Y-%m'), '') AS month, count(DISTINCT url) AS n_urls, true AS close
FROM news GROUP BY ALL"""))
def a18_distinct_sketches(spark, sf_dir):
    """Distinct urls by month: exact, and whether the union of stored daily sketches comes within four standard errors."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/mktlens-scratch/sketches-{uuid.uuid4().hex[:12]}"
    n = fx.news(spark, sf_dir).withColumn("month", F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("")))
    SK.sketches(n, ["month", "date"], "url").write.parquet(path)
    about = SK.counts(SK.united(spark.read.parquet(path), ["month"]), "about")
    exact = n.groupBy("month").agg(F.countDistinct("url").alias("n_urls"))
    close = F.abs(F.col("about") - F.col("n_urls")) <= F.greatest(F.lit(1.0), 4 * SK.error() * F.col("n_urls"))
    return exact.join(about, "month").select("month", "n_urls", close.alias("close"))


@register("F17_argmax_class", sql=with_ctes(fx.SCORES_SQL, body="""SELECT l_orderkey, l_linenumber,
  CASE WHEN (1 - p) / 2 >= p THEN 0 ELSE 1 END AS pred FROM scores"""))
def f17_argmax_class(spark, sf_dir):
    """Arg-max class of the 3-class probability vector (first index on ties)."""
    s = fx.scores(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", M.argmax_class(M.class_probabilities("p")).alias("pred"))


@register("M13_split_metrics", sql=with_ctes(fx.SCORES_SQL, """sp AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, y,
         CASE WHEN (1 - p) / 2 >= p THEN 0 ELSE 1 END AS pred,
         CASE y WHEN 1 THEN p ELSE (1 - p) / 2 END AS pt FROM scores)""", body="""SELECT c.split, c.truth, c.pred, c.count, l.log_loss, l.n
FROM (SELECT split, y AS truth, pred, count(*) AS count FROM sp GROUP BY ALL) c
JOIN (SELECT split, avg(-ln(least(greatest(pt, 1e-15), 1 - 1e-15))) AS log_loss, count(*) AS n FROM sp GROUP BY split) l USING (split)"""),
    dbl=("log_loss",))
def m13_split_metrics(spark, sf_dir):
    """Train/test bundle: confusion counts and log loss per split (split by order key)."""
    s = fx.scores(spark, sf_dir).withColumn("split", F.when(F.col("l_orderkey") % 3 == 0, "test").otherwise("train"))
    s = s.withColumn("probs", M.class_probabilities("p"))
    return M.split_metrics(s, "split", "y", "probs", [0, 1, 2]).select("split", "truth", "pred", "count", "log_loss", "n")
