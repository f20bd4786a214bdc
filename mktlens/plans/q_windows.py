"""Queries: window operators over bars (W1-W14), notebook history (X8-X10),
and the predicates that ride on them (P8, P10, P16-P19, A8, A9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from mktlens.config import FeatureConfig
from mktlens.operators import bars as B
from mktlens.operators import news as N
from mktlens.operators import samples as S
from mktlens.plans.q_features import annotated_news
from mktlens.plans.registry import register, with_ctes
from mktlens.plans.sqlparts import news_aggregates_sql, seq_avg
from mktlens.sources import fixtures as fx

CFG = FeatureConfig()
CLEAN = "ticker IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL"
WIN = "PARTITION BY ticker ORDER BY date"


def _rows(n: int) -> str:
    return f"({WIN} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# ---------------------------------------------------------------- W1
@register(
    "W1_pct_change",
    sql=with_ctes(fx.BARS_SQL, body=f"""SELECT ticker, date, close,
  close / nullif(lag(close, 1) OVER ({WIN}), 0) - 1 AS return_1,
  close / nullif(lag(close, 5) OVER ({WIN}), 0) - 1 AS return_5
FROM bars WHERE {CLEAN}"""),
    dbl=("close", "return_1", "return_5"),
)
def w1_pct_change(spark, sf_dir):
    """n-row percentage change, n in {1, 5} (row offsets, not days)."""
    return B.pct_changes(fx.bars(spark, sf_dir), (1, 5))


# ---------------------------------------------------------------- W2 / P10
FWD_SQL = f"""CASE WHEN close <> 0 THEN lead(close, 1) OVER ({WIN}) / close - 1
       WHEN lead(close, 1) OVER ({WIN}) > 0 THEN CAST('inf' AS DOUBLE)
       WHEN lead(close, 1) OVER ({WIN}) < 0 THEN CAST('-inf' AS DOUBLE) END"""


@register(
    "W2_forward_return",
    sql=with_ctes(fx.BARS_SQL, body=f"SELECT ticker, date, close, {FWD_SQL} AS target_return FROM bars WHERE {CLEAN}"),
    dbl=("close", "target_return"),
)
def w2_forward_return(spark, sf_dir):
    """Forward return at horizon 1 (NULL at the series end)."""
    return B.forward_returns(fx.bars(spark, sf_dir)).select("ticker", "date", "close", "target_return")


@register(
    "P10_direction_label",
    sql=with_ctes(fx.BARS_SQL, body=f"""SELECT ticker, date, CAST(coalesce(target_return > 0, false) AS INTEGER) AS target_direction
FROM (SELECT ticker, date, {FWD_SQL} AS target_return FROM bars WHERE {CLEAN})"""),
)
def p10_direction_label(spark, sf_dir):
    """Direction label target_return > 0; a missing return is 0."""
    return B.forward_returns(fx.bars(spark, sf_dir)).select("ticker", "date", "target_direction")


# ---------------------------------------------------------------- W3 / W4 / W5 / W6
@register(
    "W3_rolling_mean",
    sql=with_ctes(fx.BARS_SQL, body=f"""SELECT ticker, date, close,
  {seq_avg("close", _rows(5))} AS close_mean_5, {seq_avg("close", _rows(15))} AS close_mean_15,
  {seq_avg("close", _rows(200))} AS close_mean_200
FROM bars WHERE {CLEAN}"""),
    dbl=("close", "close_mean_5", "close_mean_15", "close_mean_200"),
    bench=True,
)
def w3_rolling_mean(spark, sf_dir):
    """Trailing means of width 5, 15, 200, partial windows allowed."""
    return B.rolling_mean(fx.bars(spark, sf_dir), (5, 15, 200), "close")


@register(
    "W4_rolling_std",
    sql=with_ctes(fx.BARS_SQL, body=f"SELECT ticker, date, close, stddev_samp(close) OVER {_rows(15)} AS close_std_15 FROM bars WHERE {CLEAN}"),
    dbl=("close", "close_std_15"),
)
def w4_rolling_std(spark, sf_dir):
    """Trailing sample std of width 15 (NULL for a single observation)."""
    return B.rolling_std(fx.bars(spark, sf_dir), 15, "close")


@register(
    "W5_volume_rolling_mean",
    sql=with_ctes(fx.BARS_SQL, body=f"SELECT ticker, date, volume, avg(volume) OVER {_rows(15)} AS volume_mean_15 FROM bars WHERE {CLEAN}"),
    dbl=("volume", "volume_mean_15"),
)
def w5_volume_rolling_mean(spark, sf_dir):
    """Trailing mean of volume, width 15."""
    return B.rolling_mean(fx.bars(spark, sf_dir), (15,), "volume")


@register(
    "W6_volume_zscore",
    sql=with_ctes(fx.BARS_SQL, body=f"""SELECT ticker, date, volume,
  coalesce((volume - CASE WHEN count(volume) OVER {_rows(15)} >= 2 THEN avg(volume) OVER {_rows(15)} END)
    / nullif(CASE WHEN count(volume) OVER {_rows(15)} >= 2 THEN
        CASE WHEN min(volume) OVER {_rows(15)} = max(volume) OVER {_rows(15)} THEN 0.0
             ELSE stddev_samp(volume) OVER {_rows(15)} END END, 0), 0.0) AS volume_zscore_15
FROM bars WHERE {CLEAN}"""),
    dbl=("volume", "volume_zscore_15"),
)
def w6_volume_zscore(spark, sf_dir):
    """Rolling z-score of volume over 15 rows (>= 2 obs, 0 when std is 0)."""
    return B.rolling_zscore(fx.bars(spark, sf_dir), 15, "volume")


@register(
    "P8_sma_ratio",
    sql=with_ctes(fx.BARS_SQL, body=f"""SELECT ticker, date,
  coalesce({seq_avg("close", _rows(CFG.short_window))} / nullif({seq_avg("close", _rows(CFG.long_window))}, 0) - 1, 0.0) AS sma_ratio
FROM bars WHERE {CLEAN}"""),
    dbl=("sma_ratio",),
)
def p8_sma_ratio(spark, sf_dir):
    """sma_short / sma_long - 1, 0 when undefined."""
    return B.sma_ratio(fx.bars(spark, sf_dir), CFG.short_window, CFG.long_window)


# ---------------------------------------------------------------- W7
@register(
    "W7_sentiment_roll_mean",
    sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, news_aggregates_sql(),
                  body="SELECT ticker, date, sentiment_mean, sentiment_roll_mean FROM nagg"),
    dbl=("sentiment_mean", "sentiment_roll_mean"),
)
def w7_sentiment_roll_mean(spark, sf_dir):
    """Rolling mean of daily sentiment over the last 3 days that have news."""
    agg = N.daily_news_aggregates(annotated_news(spark, sf_dir), FeatureConfig(min_news_per_day=0))
    return agg.select("ticker", "date", "sentiment_mean", "sentiment_roll_mean")


# ---------------------------------------------------------------- X8
def _ma_sql(n: int = 200) -> str:
    r = _rows(n)
    return f"""ma AS (
  SELECT ticker, date, close, volume,
         CASE WHEN count(close) OVER {r} = {n} THEN {seq_avg("close", r)} END AS ma_{n},
         CASE WHEN count(close) OVER {r} = {n} THEN stddev_samp(close) OVER {r} END AS sd,
         {seq_avg("close", f"({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS ma
  FROM bars WHERE {CLEAN}),
hist AS (
  SELECT ticker, date, close, volume, ma_{n}, ma,
         CASE WHEN ma_{n} - 2 * sd IS NOT NULL THEN greatest(ma_{n} - 2 * sd, 0.0) END AS ma_{n}_low,
         ma_{n} + 2 * sd AS ma_{n}_high
  FROM ma)"""


HIST_DBL = ("close", "volume", "ma_200", "ma", "ma_200_low", "ma_200_high")


@register("X8_enrich_history", sql=with_ctes(fx.BARS_SQL, _ma_sql(), body="SELECT * FROM hist"), dbl=HIST_DBL)
def x8_enrich_history(spark, sf_dir):
    """Strict 200-row MA, +-2 sigma bands (low clipped at 0), expanding mean."""
    return B.enrich_history(fx.bars(spark, sf_dir), 200)


@register("W8_moving_average_strict", sql=with_ctes(fx.BARS_SQL, _ma_sql(), body="SELECT ticker, date, ma_200 FROM hist"), dbl=("ma_200",))
def w8_moving_average_strict(spark, sf_dir):
    """200-row moving average, NULL until the window is full."""
    return B.enrich_history(fx.bars(spark, sf_dir), 200).select("ticker", "date", "ma_200")


@register("W9_bands", sql=with_ctes(fx.BARS_SQL, _ma_sql(), body="SELECT ticker, date, ma_200_low, ma_200_high FROM hist"),
          dbl=("ma_200_low", "ma_200_high"))
def w9_bands(spark, sf_dir):
    """+-2 sigma bands around the strict 200-row MA, low clipped at 0."""
    return B.enrich_history(fx.bars(spark, sf_dir), 200).select("ticker", "date", "ma_200_low", "ma_200_high")


@register("W10_expanding_mean", sql=with_ctes(fx.BARS_SQL, _ma_sql(), body="SELECT ticker, date, ma FROM hist"), dbl=("ma",))
def w10_expanding_mean(spark, sf_dir):
    """Expanding mean of close."""
    return B.enrich_history(fx.bars(spark, sf_dir), 200).select("ticker", "date", "ma")


# ---------------------------------------------------------------- W11 / X9
def _label_sql() -> str:
    f = f"({WIN} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)"
    return f"""base AS (SELECT ticker, date, ma_200, close FROM hist WHERE ma_200 IS NOT NULL),
fw AS (
  SELECT ticker, date, ma_200, close,
         CASE WHEN count(close) OVER {f} = 30 THEN max(close) OVER {f} END AS max_close,
         CASE WHEN count(close) OVER {f} = 30 THEN min(close) OVER {f} END AS min_close,
         close / nullif(ma_200, 0) AS relative_close
  FROM base),
tr0 AS (SELECT * FROM fw WHERE max_close IS NOT NULL),
tr AS (
  SELECT tr0.*, c.count, max_close / nullif(ma_200, 0) AS relative_future_close,
         CASE WHEN max_close / nullif(close, 0) > 1.15 THEN 2 WHEN min_close / nullif(close, 0) < 0.85 THEN 0 ELSE 1 END AS relative_future_gain
  FROM tr0 JOIN (SELECT ticker, count(DISTINCT close) AS count FROM tr0 GROUP BY ticker) c USING (ticker)
  WHERE c.count > 150),
lv0 AS (SELECT * FROM fw WHERE date > (SELECT max(date) FROM fw) - 150),
lv AS (
  SELECT lv0.*, c.count FROM lv0 JOIN (SELECT ticker, count(DISTINCT close) AS count FROM lv0 GROUP BY ticker) c USING (ticker)
  WHERE c.count >= 100)"""


LABEL_CTES = (fx.BARS_SQL, _ma_sql(), _label_sql())
TRAIN_DBL = ("ma_200", "close", "max_close", "min_close", "relative_close", "relative_future_close")


def labelled_history(spark, sf_dir):
    """(train with volume and positions, live)."""
    return B.label_history(B.averaged_history(fx.bars(spark, sf_dir), 200))


def _train_live(spark, sf_dir):
    return tuple(df.drop("_i", "_n", "volume") for df in labelled_history(spark, sf_dir))


@register("W11_forward_extremes", sql=with_ctes(*LABEL_CTES, body="SELECT ticker, date, max_close, min_close FROM fw"),
          dbl=("max_close", "min_close"))
def w11_forward_extremes(spark, sf_dir):
    """Max/min over the current and next 29 rows, strict."""
    h = B.averaged_history(fx.bars(spark, sf_dir), 200)
    return B.forward_extremes(h, 30).select("ticker", "date", "max_close", "min_close")


@register("X9_label_history_train", sql=with_ctes(*LABEL_CTES, body="SELECT * FROM tr"), dbl=TRAIN_DBL)
def x9_label_history_train(spark, sf_dir):
    """Training rows: forward window present, 3-class outcome, > 150 distinct closes."""
    return _train_live(spark, sf_dir)[0]


@register("X9_label_history_live", sql=with_ctes(*LABEL_CTES, body="SELECT * FROM lv"),
          dbl=("ma_200", "close", "max_close", "min_close", "relative_close"))
def x9_label_history_live(spark, sf_dir):
    """Live rows: newer than global max date - 150 days, >= 100 distinct closes."""
    return _train_live(spark, sf_dir)[1]


@register("P16_three_class_outcome", sql=with_ctes(*LABEL_CTES, body="SELECT ticker, date, relative_future_gain FROM tr"))
def p16_three_class_outcome(spark, sf_dir):
    """0 if forward min/close < 0.85, 2 if forward max/close > 1.15, else 1."""
    return _train_live(spark, sf_dir)[0].select("ticker", "date", "relative_future_gain")


@register("P17_relative_close", sql=with_ctes(*LABEL_CTES, body="SELECT ticker, date, relative_close, relative_future_close FROM tr"),
          dbl=("relative_close", "relative_future_close"))
def p17_relative_close(spark, sf_dir):
    """close / ma_200 and forward max / ma_200."""
    return _train_live(spark, sf_dir)[0].select("ticker", "date", "relative_close", "relative_future_close")


@register("P18_live_split", sql=with_ctes(*LABEL_CTES, body="SELECT ticker, date FROM lv0"))
def p18_live_split(spark, sf_dir):
    """Rows newer than the global max date - 150 days (before the count filter)."""
    h = B.averaged_history(fx.bars(spark, sf_dir), 200)
    mx = h.agg(F.max("date").alias("_m"))
    return h.join(F.broadcast(mx), F.col("date") > F.date_sub("_m", 150)).select("ticker", "date")


@register("A8_distinct_closes", sql=with_ctes(*LABEL_CTES, body="SELECT ticker, date, count FROM tr"))
def a8_distinct_closes(spark, sf_dir):
    """Distinct closes per ticker attached to every row (train rows)."""
    return _train_live(spark, sf_dir)[0].select("ticker", "date", "count")


@register("P19_min_history", sql=with_ctes(*LABEL_CTES, body="""SELECT ticker, count(DISTINCT close) AS distinct_closes,
  count(DISTINCT close) > 150 AS train_ok FROM tr0 GROUP BY ticker"""))
def p19_min_history(spark, sf_dir):
    """Per ticker: distinct closes among rows with a forward window, and the > 150 rule."""
    h = B.averaged_history(fx.bars(spark, sf_dir), 200)
    fw = B.forward_extremes(h, 30).where(F.col("max_close").isNotNull())
    c = B.distinct_count(fw, "close", "distinct_closes")
    return c.withColumn("train_ok", F.col("distinct_closes") > 150)


@register("A9_global_max_date", sql=with_ctes(fx.BARS_SQL, body="SELECT max(date) AS max_date FROM bars"))
def a9_global_max_date(spark, sf_dir):
    """Global max date scalar."""
    return fx.bars(spark, sf_dir).agg(F.max("date").alias("max_date"))


# ---------------------------------------------------------------- W12
@register(
    "W12_change_vs_lag",
    sql=with_ctes(fx.BARS_SQL, body=f"""SELECT ticker, date, close AS latest_close,
  CASE WHEN base IS NOT NULL AND base <> 0 THEN close / base - 1 END AS price_change_30d
FROM (SELECT ticker, date, close, lag(close, 21) OVER ({WIN}) AS base,
             row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rk FROM bars WHERE {CLEAN})
WHERE rk = 1"""),
    dbl=("latest_close", "price_change_30d"),
)
def w12_change_vs_lag(spark, sf_dir):
    """Latest close per ticker and its change against the 22nd-last row."""
    return B.change_vs_lag(fx.bars(spark, sf_dir), 21)


# ---------------------------------------------------------------- W13 / W14 / X10
SAMPLES_SQL = """pos AS (
  SELECT ticker, date, relative_close AS v, relative_future_gain AS label,
         row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i,
         count(*) OVER (PARTITION BY ticker) AS n
  FROM tr),
ex AS (
  SELECT *, unnest(range(CAST(greatest(0, ceil((i - 99) / 10.0)) AS BIGINT),
                         CAST(least(floor((n - 100) / 10), floor(i / 10)) AS BIGINT) + 1)) AS window_no
  FROM pos WHERE n >= 100),
samples AS (
  SELECT ticker, CAST(window_no AS INTEGER) AS window_no,
         max(CASE WHEN i = window_no * 10 + 99 THEN date END) AS end_date,
         max(CASE WHEN i = window_no * 10 + 99 THEN label END) AS label,
         list(v ORDER BY i) AS "values"
  FROM ex GROUP BY ticker, window_no)"""


@register("X10_window_samples", sql=with_ctes(*LABEL_CTES, SAMPLES_SQL, body="SELECT * FROM samples"), arr=("values",), bench=True)
def x10_window_samples(spark, sf_dir):
    """Windows of 100 relative closes every 10 rows with the end row's label/date."""
    train = labelled_history(spark, sf_dir)[0]
    return S.window_samples(train, "relative_close", "relative_future_gain", "ticker", "date", 100, 10)


@register("W13_strided_windows", sql=with_ctes(*LABEL_CTES, SAMPLES_SQL, body='SELECT ticker, window_no, "values" FROM samples'),
          arr=("values",))
def w13_strided_windows(spark, sf_dir):
    """Strided windows: length 100, step 10, from the series start."""
    return x10_window_samples(spark, sf_dir).select("ticker", "window_no", "values")


@register("W14_window_labels", sql=with_ctes(*LABEL_CTES, """lab AS (
  SELECT ticker, CAST((i - 99) / 10 AS INTEGER) AS window_no, date AS end_date, label
  FROM (SELECT ticker, date, relative_future_gain AS label, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM tr)
  WHERE i >= 99 AND (i - 99) % 10 = 0)""", body="SELECT * FROM lab"))
def w14_window_labels(spark, sf_dir):
    """Label, date and ticker at each window's last row."""
    train = labelled_history(spark, sf_dir)[0]
    return S.window_labels(train, "relative_future_gain", "ticker", "date", 100, 10)
