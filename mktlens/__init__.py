"""mktlens — market and news analytics as lazy Spark plans.

Sub-packages
------------
functions   column expressions (safe arithmetic, text normalisation, lexicon
            sentiment, array helpers, pair similarity)
sources     schemas, readers/writers and the fixture views over the driver tables
operators   DataFrame -> DataFrame operators (bars, news, entity resolution,
            features, metrics, models, reports, windowed samples)
plans       the query catalogue (Spark callables + DuckDB oracle SQL)
streaming   the stateless operators wired onto streaming DataFrames
"""

from mktlens.config import FeatureConfig, ModelConfig, NewsConfig  # noqa: F401

__all__ = ["FeatureConfig", "ModelConfig", "NewsConfig"]
