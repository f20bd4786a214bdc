"""DuckDB SQL fragments shared by the oracle statements.

They restate, in SQL, what the Spark operators compute, so the driver can
check each Spark plan against an independent engine.
"""
from __future__ import annotations

from mktlens.config import FeatureConfig
from mktlens.functions.exprs import WS


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank_null_sql(x: str) -> str:
    return f"CASE WHEN length({strip_sql(x)}) > 0 THEN {strip_sql(x)} END"


def seq_avg(x: str, frame: str) -> str:
    """Mean over a window frame summed left to right, the order Spark's frame
    aggregation uses, so both engines produce the same double."""
    return f"(list_reduce(list({x}) OVER {frame}, lambda a, b: a + b) / count({x}) OVER {frame})"


def norm_sql(x: str) -> str:
    """F1 normaliser."""
    return f"lower(trim(regexp_replace({x}, '[^0-9A-Za-zА-Яа-яЁё]+', ' ', 'g')))"


def price_features_sql(src: str = "bars", cfg: FeatureConfig = FeatureConfig()) -> str:
    s, lw, p, h = cfg.short_window, cfg.long_window, cfg.price_rolling_days, cfg.target_horizon_days
    return f"""price0 AS (
  SELECT ticker, date, close, volume,
         close / nullif(lag(close, 1) OVER w, 0) - 1 AS r1,
         close / nullif(lag(close, 5) OVER w, 0) - 1 AS r5,
         {seq_avg("close", f"(w ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)")} AS sma_s,
         {seq_avg("close", f"(w ROWS BETWEEN {lw - 1} PRECEDING AND CURRENT ROW)")} AS sma_l,
         avg(volume) OVER (w ROWS BETWEEN {lw - 1} PRECEDING AND CURRENT ROW) AS vmean,
         count(volume) OVER (w ROWS BETWEEN {lw - 1} PRECEDING AND CURRENT ROW) AS vn,
         min(volume) OVER (w ROWS BETWEEN {lw - 1} PRECEDING AND CURRENT ROW) AS vmin,
         max(volume) OVER (w ROWS BETWEEN {lw - 1} PRECEDING AND CURRENT ROW) AS vmax,
         stddev_samp(volume) OVER (w ROWS BETWEEN {lw - 1} PRECEDING AND CURRENT ROW) AS vstd,
         lead(close, {h}) OVER w AS fwd
  FROM {src}
  WHERE ticker IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL
  WINDOW w AS (PARTITION BY ticker ORDER BY date)),
price AS (
  SELECT ticker, date, close, volume,
         coalesce(r1, 0.0) AS return_1d,
         coalesce(r5, 0.0) AS return_5d,
         coalesce(stddev_samp(r1) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW), 0.0) AS vol_roll_std,
         coalesce(sma_s / nullif(sma_l, 0) - 1, 0.0) AS sma_ratio,
         coalesce(vmean, volume) AS volume_roll_mean,
         coalesce((volume - CASE WHEN vn >= 2 THEN vmean END)
                  / nullif(CASE WHEN vn >= 2 THEN CASE WHEN vmin = vmax THEN 0.0 ELSE vstd END END, 0), 0.0) AS volume_zscore,
         CASE WHEN close <> 0 THEN fwd / close - 1
              WHEN fwd > 0 THEN CAST('inf' AS DOUBLE)
              WHEN fwd < 0 THEN CAST('-inf' AS DOUBLE) END AS target_return
  FROM price0)"""


def news_aggregates_sql(src: str = "annotated", cfg: FeatureConfig = FeatureConfig(),
                        score: str = "sentiment_score", langs: tuple[str, ...] = ("detected_language", "language")) -> str:
    lang_list = ", ".join(blank_null_sql(c) for c in langs)
    return f"""nbase AS (
  SELECT ticker, date, coalesce(CAST({score} AS DOUBLE), 0.0) AS s,
         coalesce(CAST(tone AS DOUBLE), 0.0) AS tone, coalesce(CAST(relevance AS DOUBLE), 0.0) AS relevance,
         [{lang_list}] AS langs
  FROM {src} WHERE ticker IS NOT NULL AND date IS NOT NULL),
nagg0 AS (
  SELECT ticker, date,
         avg(s) AS sentiment_mean,
         coalesce(stddev_samp(s), 0.0) AS sentiment_std,
         median(s) AS sentiment_median,
         avg(CAST(s > 0.05 AS DOUBLE)) AS sentiment_pos_ratio,
         avg(CAST(s < -0.05 AS DOUBLE)) AS sentiment_neg_ratio,
         avg(CAST(abs(s) >= 0.5 AS DOUBLE)) AS sentiment_extreme_ratio,
         count(*) AS news_count,
         avg(tone) AS tone_mean, avg(relevance) AS relevance_mean, avg(tone * relevance) AS news_impact_mean,
         list_sort(list_distinct(flatten(list(langs)))) AS ll
  FROM nbase GROUP BY ticker, date),
nagg AS (
  SELECT ticker, date, sentiment_mean, sentiment_std, sentiment_median, sentiment_pos_ratio, sentiment_neg_ratio,
         sentiment_extreme_ratio, news_count, tone_mean, relevance_mean, news_impact_mean,
         coalesce(array_to_string(ll, ','), '') AS languages, CAST(len(ll) AS BIGINT) AS languages_count,
         coalesce(avg(sentiment_mean) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {cfg.sentiment_rolling_days - 1} PRECEDING AND CURRENT ROW), 0.0) AS sentiment_roll_mean
  FROM nagg0)"""


NEWS_FEATURE_SELECT = """coalesce(n.sentiment_mean, 0.0) AS sentiment_mean, coalesce(n.sentiment_std, 0.0) AS sentiment_std,
  coalesce(n.sentiment_median, 0.0) AS sentiment_median, coalesce(n.sentiment_pos_ratio, 0.0) AS sentiment_pos_ratio,
  coalesce(n.sentiment_neg_ratio, 0.0) AS sentiment_neg_ratio, coalesce(n.sentiment_extreme_ratio, 0.0) AS sentiment_extreme_ratio,
  coalesce(n.news_count, 0) AS news_count, coalesce(n.tone_mean, 0.0) AS tone_mean, coalesce(n.relevance_mean, 0.0) AS relevance_mean,
  coalesce(n.news_impact_mean, 0.0) AS news_impact_mean, coalesce(n.languages, '') AS languages,
  coalesce(n.languages_count, 0) AS languages_count, coalesce(n.sentiment_roll_mean, 0.0) AS sentiment_roll_mean"""


def feature_matrix_sql(train: bool, cfg: FeatureConfig = FeatureConfig()) -> str:
    """SELECT body of X1/X2 over CTEs price and nagg."""
    where = "WHERE p.target_return IS NOT NULL" if train else ""
    tr = "p.target_return" if train else "coalesce(p.target_return, 0.0)"
    return f"""SELECT p.ticker, p.date, p.close, p.volume, p.return_1d, p.return_5d, p.vol_roll_std, p.sma_ratio,
  p.volume_roll_mean, p.volume_zscore, {tr} AS target_return,
  CAST(coalesce(p.target_return > 0, false) AS INTEGER) AS target_direction,
  {NEWS_FEATURE_SELECT}
FROM price p LEFT JOIN (SELECT * FROM nagg WHERE news_count >= {cfg.min_news_per_day}) n
  ON p.ticker = n.ticker AND p.date = n.date
{where}"""


FEATURE_DOUBLES = (
    "close", "volume", "return_1d", "return_5d", "vol_roll_std", "sma_ratio", "volume_roll_mean", "volume_zscore",
    "target_return", "sentiment_mean", "sentiment_std", "sentiment_median", "sentiment_pos_ratio",
    "sentiment_neg_ratio", "sentiment_extreme_ratio", "tone_mean", "relevance_mean", "news_impact_mean",
    "sentiment_roll_mean",
)
