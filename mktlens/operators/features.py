"""Feature matrix (X1, X2): price windows ⟕ daily news aggregates.

Plan shape: bars -> Exchange(ticker) -> Sort -> Window (all price windows);
news -> partial agg -> Exchange(ticker, date) -> final agg -> Window(ticker);
then one join on (ticker, date).  The news aggregate is at most one row per
(ticker, date) and never larger than the bars side, so AQE can turn the join
into a broadcast at run time when it is measured small; no static broadcast of
a data-sized side.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.config import FeatureConfig
from mktlens.operators.bars import PRICE_FEATURE_COLUMNS, price_features
from mktlens.operators.news import NEWS_FEATURE_COLUMNS, daily_news_aggregates

FEATURE_COLUMNS = PRICE_FEATURE_COLUMNS + NEWS_FEATURE_COLUMNS
TARGETS = ("target_return", "target_direction")
# Model inputs: the numeric columns minus the two targets (P20), in matrix order.
MODEL_FEATURES = [
    c for c in FEATURE_COLUMNS if c not in ("ticker", "date", "languages") + TARGETS
]

# J1 fill values for the unmatched side.
NEWS_FILL = {
    "news_count": 0,
    "sentiment_mean": 0.0,
    "sentiment_std": 0.0,
    "sentiment_median": 0.0,
    "sentiment_pos_ratio": 0.0,
    "sentiment_neg_ratio": 0.0,
    "sentiment_extreme_ratio": 0.0,
    "sentiment_roll_mean": 0.0,
    "tone_mean": 0.0,
    "relevance_mean": 0.0,
    "news_impact_mean": 0.0,
    "languages": "",
    "languages_count": 0,
}


def merge_features(bars: DataFrame, news: DataFrame | None, cfg: FeatureConfig = FeatureConfig(),
                   normalize_day: bool = False) -> DataFrame:
    """Price features ⟕ news aggregates on (ticker, date) (T12: exact key;
    ``normalize_day`` truncates both sides to the day)."""
    price = price_features(bars, cfg)
    if news is None:
        joined = price
        for c, v in NEWS_FILL.items():
            joined = joined.withColumn(c, F.lit(v))
    else:
        agg = daily_news_aggregates(news, cfg)
        if normalize_day:
            price = price.withColumn("_day", F.to_date("date"))
            agg = agg.withColumn("_day", F.to_date("date")).drop("date")
            joined = price.join(agg, ["ticker", "_day"], "left").drop("_day")
        else:
            joined = price.join(agg, ["ticker", "date"], "left")
        joined = joined.na.fill(NEWS_FILL)
    return joined.select(*FEATURE_COLUMNS)


def build_features(bars: DataFrame, news: DataFrame | None, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Training matrix — rows without a forward return dropped, numeric
    NULLs -> 0 (T13)."""
    return training_rows(merge_features(bars, news, cfg))


def training_rows(merged: DataFrame) -> DataFrame:
    """X1 from the merged features."""
    return fill_numeric(merged.where(F.col("target_return").isNotNull()))


def build_features_for_inference(bars: DataFrame, news: DataFrame | None, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """As X1 but keeps the newest rows; their target_return becomes 0.0."""
    return fill_numeric(merge_features(bars, news, cfg))


def fill_numeric(df: DataFrame) -> DataFrame:
    """P5: every numeric NULL -> 0."""
    num = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.na.fill(0, subset=[c for c, t in df.dtypes if c in num and t not in ("double", "float")]).na.fill(
        0.0, subset=[c for c, t in df.dtypes if c in num and t in ("double", "float")]
    )


def model_matrix(df: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """P20: reindex to the model's columns, absent ones as 0.0, NULL -> 0."""
    present = set(df.columns)
    cols = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)).alias(c) for c in columns
    ]
    keep = [c for c in ("ticker", "date") if c in present]
    return df.select(*keep, *cols)


def numeric_feature_columns(df: DataFrame) -> list[str]:
    """P20 (schema scan): all numeric columns except the targets."""
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in TARGETS]
