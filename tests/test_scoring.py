"""Models as expressions give what the fitted pipelines give; reports with a model."""
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from mktlens.config import ModelConfig
from mktlens.operators import models as MD
from mktlens.operators import report as R
from mktlens.operators import scoring as SC
from mktlens.sources.stubs import stub_summariser_factory

COLUMNS = ["a", "b", "c", "constant"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.gauss(0, 3), rng.gauss(5, 1), float(rng.randrange(4)), 2.0) for i in range(400)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, constant double")
    return df.withColumn("label", ((F.col("a") + F.col("c") * F.sin("b") + F.col("id") % 3) > 1).cast("double")).cache()


@pytest.mark.parametrize("name,params", [("logistic_regression", {}), ("random_forest", {"n_estimators": 12, "max_depth": 5}),
                                         ("gradient_boosting", {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.3})])
@pytest.mark.parametrize("scaled", [True, False])
def test_expression_equals_transform(spark, rows, tmp_path, name, params, scaled):
    stages = MD.assembler_scaler(COLUMNS)
    if not scaled:
        stages = [stages[0].copy().setOutputCol("features")]
    model = Pipeline(stages=[*stages, MD.build_estimator(ModelConfig(estimator=name, params=params), 400)]).fit(rows)
    SC.save(SC.export(model), f"{tmp_path}/m.json")
    saved = SC.load(f"{tmp_path}/m.json")
    both = SC.score(MD.prob_up(model.transform(rows), "p"), saved, "q").select("p", "q").collect()
    assert max(abs(r.p - r.q) for r in both) < 1e-12 and len({r.q for r in both}) > 5


def test_missing_values_and_columns_are_zero(spark, rows):
    model = MD.interval_tree(rows, COLUMNS, depth=4)
    saved = SC.export(model)
    df = spark.createDataFrame([(None, 1.0, float("3"))], "a double, b double, c double")
    want = MD.prob_up(model.transform(spark.createDataFrame([(0.0, 1.0, 3.0, 0.0)], ", ".join(f"{c} double" for c in COLUMNS)))).first().probability_up
    got = SC.score(df, saved)
    assert got.columns == ["a", "b", "c", "probability_up"] and got.first().probability_up == want
    with pytest.raises(ValueError):
        SC.export(MD.interval_tree(rows.withColumn("label", F.col("c")), ["a"]))


def test_report_has_probability_and_signal_lines(spark):
    companies = spark.createDataFrame([("A", "Alpha"), ("B", None)], "symbol string, company string")
    features = spark.createDataFrame([("A", 1, 10.0)], "ticker string, date int, close double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), "date"))
    news = spark.createDataFrame([], "ticker string, seen_datetime timestamp, date date, title string, full_text string, url string, source string, language string, sentiment_score double")
    p = spark.createDataFrame([("A", 0.731)], "ticker string, probability_up double")
    got = {r.symbol: r.messages for r in R.render_report(R.company_report(companies, features, news, p)).collect()}
    assert R.HEADER_PROB.format(p="73.1%") in got["A"][0] and R.HEADER_SIGNAL.format(d=R.LABEL_UP) in got["A"][0]
    assert R.HEADER_PROB.split("{")[0] not in got["B"][0]


def test_summariser_falls_back_text_by_text(spark):
    texts = ["abc", "abcd", "abcde. More. Text. Here.", "abcdef", "seven..", "", None, "   "]
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "id int, docs array<string>").coalesce(1)
    got = {r.id: (r.summary, r.used_model) for r in MD.summariser(df, "docs", stub_summariser_factory, "m").collect()}
    assert got[0] == ("3: abc", "m") and got[1] == ("4: abcd", "m")
    assert got[2] == ("24: abcde. More. Text. Here.", "m")
    assert got[3] == ("abcdef.", None)  # NULL
    assert got[4] == ("seven.", None)  # empty
    assert got[5] == got[6] == got[7] and got[5][1] is None
    plain = {r.id: (r.summary, r.used_model) for r in MD.summariser(df, "docs").collect()}
    assert plain[2] == ("abcde. More. Text.", None) and plain[5] == got[5]


def test_training_computes_its_features_once(spark):
    from mktlens.config import ModelConfig

    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"t{i % 3}", i, float(i % 7), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "ticker string, date int, a double, target_direction int").mapInArrow(run, "ticker string, date int, a double, target_direction int")
    MD.train(df, ["a"], ModelConfig(estimator="logistic_regression"))
    assert seen.value == 120


@pytest.mark.parametrize("name", ["M10_fitted_expressions", "S9_latest_model"])
def test_model_queries_build_their_features_once(spark, monkeypatch, name):
    from conftest import SF001
    from mktlens.plans import REGISTRY
    from mktlens.sources import fixtures as fx

    made = []
    for table in ("bars", "news"):
        monkeypatch.setattr(fx, table, lambda *a, f=getattr(fx, table), t=table: made.append(t) or f(*a))
    assert REGISTRY.queries[name].run(spark, SF001).count() == 25
    assert sorted(made) == ["bars", "news"]


def test_summariser_hands_only_the_joined_texts_to_python(spark):
    df = spark.createDataFrame([(1, ["a" * 9, None], "x"), (2, None, "y"), (3, [" ", ""], "z")], "id int, docs array<string>, other string")
    out = MD.summariser(df, "docs", stub_summariser_factory, "m")
    assert out.columns == ["id", "docs", "other", "summary", "used_model"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    assert [(r.id, r.other, r.used_model) for r in out.orderBy("id").collect()] == [(1, "x", "m"), (2, "y", None), (3, "z", None)]
