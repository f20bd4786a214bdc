"""Window operators over price bars.

All windows of one operator run over the same halo'd row chunks of
``mktlens.operators.chunked``, so one Exchange + Sort feeds every Window node and
no task holds a whole series.  Rows lacking a close or volume are removed
*before* any lag/rolling (T7); row offsets are row counts, not calendar days (T8).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mktlens.config import FeatureConfig
from mktlens.operators.chunked import add_earlier_chunks, apply_windows, chunk_window, running, with_halo
from mktlens.functions.exprs import (
    clip_lower,
    direction,
    forward_return,
    pct_change,
    rows_frame,
    safe_div,
    strict,
    zero_if_null,
    zscore_std,
)

# The output column contract, in order.
PRICE_FEATURE_COLUMNS = [
    "ticker",
    "date",
    "close",
    "volume",
    "return_1d",
    "return_5d",
    "vol_roll_std",
    "sma_ratio",
    "volume_roll_mean",
    "volume_zscore",
    "target_return",
    "target_direction",
]


def clean_bars(bars: DataFrame) -> DataFrame:
    """Drop rows without ticker, close or volume before any window."""
    return bars.where(F.col("ticker").isNotNull() & F.col("close").isNotNull() & F.col("volume").isNotNull())


# ---------------------------------------------------------------- W1 / W2
def pct_change_n(close: str, n: int, w: Window) -> Column:
    """N-row percentage change."""
    return pct_change(F.col(close), F.lag(close, n).over(w))


def forward_return_h(close: str, h: int, w: Window) -> Column:
    """Forward return at horizon h."""
    return forward_return(F.col(close), F.lead(close, h).over(w))


def pct_changes(bars: DataFrame, widths=(1, 5)) -> DataFrame:
    """W1 over whole series: one column ``return_<n>`` per width."""

    def build(b, w):
        return b.select("ticker", "date", "close", *[pct_change_n("close", n, w).alias(f"return_{n}") for n in widths], *_keep(b))

    return apply_windows(clean_bars(bars), build, lookback=max(widths))


def forward_returns(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """W2 over whole series, with the direction label (P10)."""

    def build(b, w):
        return b.select("ticker", "date", "close", forward_return_h("close", horizon, w).alias("target_return"), *_keep(b))

    return apply_windows(clean_bars(bars), build, lookahead=horizon).withColumn("target_direction", direction("target_return"))


def sma_ratio(bars: DataFrame, short: int, long: int) -> DataFrame:
    """Short mean / long mean - 1, 0 when undefined."""

    def build(b, w):
        ratio = safe_div(F.avg("close").over(rows_frame(w, short)), F.avg("close").over(rows_frame(w, long))) - F.lit(1.0)
        return b.select("ticker", "date", zero_if_null(ratio).alias("sma_ratio"), *_keep(b))

    return apply_windows(clean_bars(bars), build, lookback=max(short, long) - 1)


# ---------------------------------------------------------------- X1 price half
def price_features(bars: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Price part of the feature matrix (reference ``_prepare_price_features``).

    Input: conformed bars (ticker, date, close, volume).
    """
    s, lw, p = cfg.short_window, cfg.long_window, cfg.price_rolling_days
    h = cfg.target_horizon_days

    def build(b: DataFrame, w: Window) -> DataFrame:
        b = b.withColumn("_r1", pct_change_n("close", 1, w))
        sma_s = F.avg("close").over(rows_frame(w, s))
        sma_l = F.avg("close").over(rows_frame(w, lw))
        vol_std = F.stddev_samp("_r1").over(rows_frame(w, p))
        vol_mean = F.avg("volume").over(rows_frame(w, lw))
        wl = rows_frame(w, lw)
        z_mean = F.when(F.count("volume").over(wl) >= 2, F.avg("volume").over(wl))
        z = safe_div(F.col("volume") - z_mean, zscore_std("volume", wl, 2))
        fwd = forward_return_h("close", h, w)
        keep = [c for c in b.columns if c.startswith("_") and c != "_r1"]
        return b.select(
            "ticker",
            "date",
            "close",
            "volume",
            zero_if_null("_r1").alias("return_1d"),
            zero_if_null(pct_change_n("close", 5, w)).alias("return_5d"),
            zero_if_null(vol_std).alias("vol_roll_std"),
            zero_if_null(safe_div(sma_s, sma_l) - F.lit(1.0)).alias("sma_ratio"),
            F.coalesce(vol_mean, F.col("volume")).alias("volume_roll_mean"),
            zero_if_null(z).alias("volume_zscore"),
            fwd.alias("target_return"),
            *keep,
        )

    base = clean_bars(bars).select("ticker", "date", "close", "volume")
    # lag 1 feeds a p-row std, so the deepest look back is max(lw - 1, p, 5).
    out = apply_windows(base, build, lookback=max(lw - 1, p, 5), lookahead=h)
    return out.withColumn("target_direction", direction("target_return"))


# ---------------------------------------------------------------- W3-W6 single ops
def _keep(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_")]


def rolling_mean(bars: DataFrame, widths=(5, 15, 200), value: str = "close") -> DataFrame:
    """Trailing mean with partial windows allowed (min_periods=1)."""

    def build(b, w):
        cols = [F.avg(value).over(rows_frame(w, n)).alias(f"{value}_mean_{n}") for n in widths]
        return b.select("ticker", "date", value, *cols, *_keep(b))

    return apply_windows(clean_bars(bars), build, lookback=max(widths) - 1)


def rolling_std(bars: DataFrame, width: int = 15, value: str = "close") -> DataFrame:
    """Trailing sample std (NULL with one observation)."""

    def build(b, w):
        return b.select("ticker", "date", value, F.stddev_samp(value).over(rows_frame(w, width)).alias(f"{value}_std_{width}"), *_keep(b))

    return apply_windows(clean_bars(bars), build, lookback=width - 1)


def rolling_zscore(bars: DataFrame, width: int = 15, value: str = "volume") -> DataFrame:
    """(v - mean)/std over ``width`` rows, >= 2 observations, 0 when std is 0."""

    def build(b, w0):
        w = rows_frame(w0, width)
        mean = F.when(F.count(value).over(w) >= 2, F.avg(value).over(w))
        z = safe_div(F.col(value) - mean, zscore_std(value, w, 2))
        return b.select("ticker", "date", value, zero_if_null(z).alias(f"{value}_zscore_{width}"), *_keep(b))

    return apply_windows(clean_bars(bars), build, lookback=width - 1)


# ---------------------------------------------------------------- notebook history
def enrich_history(bars: DataFrame, n: int = 200, bands: float = 2.0) -> DataFrame:
    """X8 = W8 strict n-row moving average, W9 +-2 sigma bands (low clipped at
    0), W10 expanding mean."""
    out = add_earlier_chunks(_averages(bars, n), "ticker", "_total", "_count").withColumn("ma", F.col("_total") / F.col("_count"))
    return out.select(
        "ticker", "date", "close", "volume", f"ma_{n}", "ma",
        clip_lower(F.col(f"ma_{n}") - bands * F.col("_sd"), 0.0).alias(f"ma_{n}_low"),
        (F.col(f"ma_{n}") + bands * F.col("_sd")).alias(f"ma_{n}_high"),
    )


def _averages(bars: DataFrame, n: int) -> DataFrame:
    """Bars with the strict n-row mean and std, and running sums inside chunks."""
    base = clean_bars(bars).select("ticker", "date", "close", "volume")
    h = with_halo(base, "ticker", "date", n - 1, 0)
    w = chunk_window()
    wn = rows_frame(w, n)
    total, count = running("close", w)
    return h.select(
        "*",
        strict(F.avg("close"), "close", wn, n).alias(f"ma_{n}"),
        strict(F.stddev_samp("close"), "close", wn, n).alias("_sd"),
        total.alias("_total"),
        count.alias("_count"),
    ).where("_home")


def averaged_history(bars: DataFrame, n: int = 200) -> DataFrame:
    """The rows of X8 that have a full window: all but the first n - 1 of each
    series, so their positions are known and go along (``_i``, ``_n``)."""
    rows = _averages(bars, n).where(F.col("_i") >= n - 1)
    return rows.select("ticker", "date", "close", "volume", f"ma_{n}", (F.col("_i") - (n - 1)).alias("_i"), (F.col("_n") - (n - 1)).alias("_n"))


def forward_extremes(df: DataFrame, n: int = 30, value: str = "close") -> DataFrame:
    """max/min over the current and next n-1 rows, strict (NULL when fewer
    than n rows remain)."""

    def build(b, w0):
        w = w0.rowsBetween(0, n - 1)
        return b.withColumn("max_close", strict(F.max(value), value, w, n)).withColumn("min_close", strict(F.min(value), value, w, n))

    return apply_windows(df, build, lookahead=n - 1)


def three_class_outcome(max_close: Column, min_close: Column, close: Column, up: float = 1.15, down: float = 0.85) -> Column:
    """2 if forward max/close > up, else 0 if forward min/close < down, else 1."""
    return (
        F.when(safe_div(max_close, close) > up, F.lit(2))
        .when(safe_div(min_close, close) < down, F.lit(0))
        .otherwise(F.lit(1))
    )


def label_history(enriched: DataFrame, n_ma: int = 200, horizon: int = 30, live_days: int = 150,
                  min_train: int = 150, min_live: int = 100) -> tuple[DataFrame, DataFrame]:
    """(train, live) from an enriched history.

    train: rows with a forward window, outcome class (P16), relative closes
    (P17), tickers with > ``min_train`` distinct closes (A8, P19); with volume and
    positions ``_i`` and ``_n`` as far as ``enriched`` has them.
    live: rows newer than global max date - ``live_days`` (P18, A9) of tickers
    with >= ``min_live`` distinct closes.
    """
    ma = f"ma_{n_ma}"
    base = enriched.where(F.col(ma).isNotNull()).select("ticker", "date", ma, "close", *[c for c in ("volume", "_i", "_n") if c in enriched.columns])
    base = forward_extremes(base, horizon).withColumn("relative_close", safe_div(F.col("close"), F.col(ma)))

    # One-row global max joined back (broadcast of a single row).
    max_date = base.agg(F.max("date").alias("_max_date"))
    live = base.join(F.broadcast(max_date), F.col("date") > F.date_sub(F.col("_max_date"), live_days)).drop("_max_date")
    live = live.join(distinct_count(live, "close", "count"), "ticker")
    live = live.where(F.col("count") >= min_live).drop("_i", "_n", "volume")

    # the last horizon - 1 rows of a series go, so positions stay and lengths shrink
    train = base.where(F.col("max_close").isNotNull())
    if "_n" in train.columns:
        train = train.withColumn("_n", F.col("_n") - (horizon - 1))
    train = train.join(distinct_count(train, "close", "count"), "ticker")
    train = (
        train.withColumn("relative_future_close", safe_div(F.col("max_close"), F.col(ma)))
        .withColumn("relative_future_gain", three_class_outcome(F.col("max_close"), F.col("min_close"), F.col("close")))
        .where(F.col("count") > min_train)
    )
    return train, live


def distinct_count(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values per ticker as a (ticker, n) table; joined back by the
    caller (partial aggregation instead of a per-row collect_set)."""
    return df.select("ticker", value).distinct().groupBy("ticker").agg(F.count(F.lit(1)).alias(name))


def turnover_gain_bins(train: DataFrame, cuts=(0.0, 0.8, 1.2, 10_000.0)) -> DataFrame:
    """Turnover (close x volume) and the future gain in right-closed bins."""
    r = F.col("relative_future_close")
    bins = F.lit(None).cast("int")
    for k in range(len(cuts) - 1):
        bins = F.when((r > cuts[k]) & (r <= cuts[k + 1]), F.lit(k)).otherwise(bins)
    return train.select("ticker", "date", (F.col("close") * F.col("volume")).alias("turnover"), bins.alias("gain_bin"))


# ---------------------------------------------------------------- W12
def change_vs_lag(bars: DataFrame, lag_rows: int = 21) -> DataFrame:
    """Latest close per ticker and its change against the row ``lag_rows``
    before it, only when more than ``lag_rows`` rows exist and the base is
    non-zero."""
    b = clean_bars(bars).select("ticker", "date", "close")
    b = apply_windows(b, lambda x, w: x.withColumn("_base", F.lag("close", lag_rows).over(w)), lookback=lag_rows)
    latest = b.groupBy("ticker").agg(F.max_by(F.struct("close", "_base", "date"), "date").alias("s"))
    return latest.select(
        "ticker",
        F.col("s.date").alias("date"),
        F.col("s.close").alias("latest_close"),
        F.when(F.col("s._base").isNotNull() & (F.col("s._base") != 0), F.col("s.close") / F.col("s._base") - F.lit(1.0)).alias(
            "price_change_30d"
        ),
    )
