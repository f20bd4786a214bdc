"""Queries: feature matrix and its parts (X1-X3, J1, J2, A1-A5, W1-W7, P*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from mktlens.config import FeatureConfig
from mktlens.functions.sentiment import FIXTURE_LEXICON
from mktlens.operators import bars as B
from mktlens.operators import features as X
from mktlens.operators import news as N
from mktlens.plans.registry import register, with_ctes
from mktlens.plans.sqlparts import (
    FEATURE_DOUBLES,
    feature_matrix_sql,
    news_aggregates_sql,
    price_features_sql,
)
from mktlens.sources import fixtures as fx

CFG = FeatureConfig()


def annotated_news(spark, sf_dir):
    return N.annotate_news(fx.news(spark, sf_dir), "full_text", FIXTURE_LEXICON)


@register(
    "X1_build_features",
    sql=with_ctes(fx.BARS_SQL, fx.NEWS_SQL, fx.ANNOTATED_SQL, price_features_sql(), news_aggregates_sql(),
                  body=feature_matrix_sql(train=True)),
    dbl=FEATURE_DOUBLES,
    bench=True,
)
def x1_build_features(spark, sf_dir):
    """Training feature matrix: price windows ⟕ daily news aggregates."""
    return X.build_features(fx.bars(spark, sf_dir), annotated_news(spark, sf_dir), CFG)


@register(
    "X2_build_features_for_inference",
    sql=with_ctes(fx.BARS_SQL, fx.NEWS_SQL, fx.ANNOTATED_SQL, price_features_sql(), news_aggregates_sql(),
                  body=feature_matrix_sql(train=False)),
    dbl=FEATURE_DOUBLES,
)
def x2_build_features_for_inference(spark, sf_dir):
    """Inference matrix: newest rows kept, their target_return is 0.0."""
    return X.build_features_for_inference(fx.bars(spark, sf_dir), annotated_news(spark, sf_dir), CFG)
