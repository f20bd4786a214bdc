"""Fits the models that the report and scoring queries load, on the feature matrix
of a table folder, and saves their numbers: python tools/export_model.py [folder]."""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mktlens.config import ModelConfig  # noqa: E402
from mktlens.operators import features as X  # noqa: E402
from mktlens.operators import models as MD  # noqa: E402
from mktlens.operators import scoring as SC  # noqa: E402
from mktlens.plans.q_features import x1_build_features  # noqa: E402
from mktlens.session import cut_lineage, local_session  # noqa: E402

CONFIGS = {
    "logistic": ModelConfig(estimator="logistic_regression"),
    "forest": ModelConfig(estimator="random_forest", params={"n_estimators": 7, "max_depth": 3}),
}


def main(folder: str = "/root/testdata/sf0.01") -> None:
    spark = local_session(4, 8, "mktlens-export")
    matrix = cut_lineage(x1_build_features(spark, folder))
    to = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "mktlens", "plans")
    for name, cfg in CONFIGS.items():
        model, _, metrics = MD.train(matrix, X.MODEL_FEATURES, cfg)
        SC.save(SC.export(model), f"{to}/saved_{name}.json")
        print(name, metrics.first())
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
