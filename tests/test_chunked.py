"""Windows over halo'd chunks equal plain per-key windows; plans are lazy; medians, readers, models."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from mktlens.operators import bars as B
from mktlens.operators import chunked as C
from mktlens.operators import samples as S
from mktlens.sources import fixtures as fx


def assert_close(a, b, keys=2, tol=1e-9):
    da = {tuple(r[:keys]): r for r in a.collect()}
    db = {tuple(r[:keys]): r for r in b.collect()}
    assert set(da) == set(db)
    for k, ra in da.items():
        for x, y in zip(ra[keys:], db[k][keys:]):
            assert (x is None) == (y is None), k
            if x is not None:
                assert abs(x - y) <= tol * max(1.0, abs(x)), (k, x, y)


def rows(df, ndigits=9):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, ndigits) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.fixture(params=[1_000_000, 250])
def chunk_rows(request, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", request.param)


def plain(order="date"):
    return Window.partitionBy("ticker").orderBy(order)


def test_rolling_and_lag_equal_plain_windows(spark, chunk_rows):
    b = B.clean_bars(fx.bars(spark, SF01))
    w = plain()
    want = b.select("ticker", "date", "close", F.avg("close").over(w.rowsBetween(-199, 0)).alias("m"))
    assert rows(B.rolling_mean(b, (200,))) == rows(want)
    want = b.select("ticker", "date", "close", (F.lead("close", 1).over(w) / F.col("close") - 1).alias("r"))
    assert rows(B.forward_returns(b).select("ticker", "date", "close", "target_return")) == rows(want)


def test_history_equals_plain_windows(spark, chunk_rows):
    b = B.clean_bars(fx.bars(spark, SF01))
    w = plain()
    got = B.enrich_history(b, 200).select("ticker", "date", "ma", "ma_200")
    full = F.count("close").over(w.rowsBetween(-199, 0)) == 200
    want = b.select("ticker", "date", F.avg("close").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ma"),
                    F.when(full, F.avg("close").over(w.rowsBetween(-199, 0))).alias("ma_200"))
    assert_close(got, want)


def test_positions_and_lengths(spark):
    b = fx.bars(spark, SF01).select("ticker", "date")
    w = Window.partitionBy("ticker")
    want = b.select("ticker", "date", (F.row_number().over(w.orderBy("date")) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    assert rows(C.positions(b, "ticker", "date").select("ticker", "date", "_i", "_n")) == rows(want)


def test_rows_without_a_date_and_of_one_time_have_a_place(spark):
    rows = [("A", None, float(i)) for i in range(3)] + [("A", "2024-01-01", 1.0), ("A", "2024-01-01", 2.0), ("A", "2025-06-01", 3.0), ("B", None, 9.0)]
    df = spark.createDataFrame(rows, "ticker string, date string, v double").withColumn("date", F.to_date("date"))
    got = [{tuple(r) for r in C.positions(df.repartition(n), "ticker", "date").select("ticker", "date", "v", "_i", "_n").collect()} for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2]
    assert sorted((r[0], r[3], r[4]) for r in got[0]) == [("A", i, 6) for i in range(6)] + [("B", 0, 1)]
    assert {r[3] for r in got[0] if r[0] == "A" and r[1] is None} == {0, 1, 2}


@pytest.mark.parametrize("length,step", [(100, 10), (25, 10), (7, 3), (5, 8)])
def test_window_samples_against_lists(spark, monkeypatch, length, step):
    monkeypatch.setattr(S, "BLOCKS", 6)
    b = fx.bars(spark, SF01).where("ticker in ('Brand#11', 'Brand#1', 'Brand#2')")
    got = {(r.ticker, r.window_no): (r.end_date, r.label, r["values"]) for r in S.window_samples(b, "close", "volume", length=length, step=step).collect()}
    series = {}
    for r in sorted(b.collect(), key=lambda r: r.date):
        series.setdefault(r.ticker, []).append(r)
    want = {}
    for t, rs in series.items():
        for k in range((len(rs) - length) // step + 1 if len(rs) >= length else 0):
            part = rs[k * step : k * step + length]
            want[t, k] = (part[-1].date, part[-1].volume, [x.close for x in part])
    assert got == want


def test_a_hot_series_is_cut_into_bounded_tasks(spark, monkeypatch):
    """One ticker with 90 % of the rows: no window partition is larger than a chunk
    and its halo."""
    monkeypatch.setattr(C, "CHUNK_ROWS", 100)
    hot = spark.range(0, 1800).selectExpr("'HOT' AS ticker", "date_add(DATE'2000-01-01', cast(id as int)) AS date", "cast(id % 7 as double) AS close", "1.0D AS volume")
    cold = spark.range(0, 200).selectExpr("concat('C', id % 10) AS ticker", "date_add(DATE'2000-01-01', cast(id as int)) AS date", "1.0D AS close", "1.0D AS volume")
    h = C.with_halo(hot.unionByName(cold), "ticker", "date", 14, 3)
    assert h.where("_home").count() == 2000
    assert h.groupBy("ticker", "_chunk").count().agg(F.max("count")).first()[0] <= 100 + 14 + 3
    # and numbering never puts more than a calendar bucket together
    assert hot.groupBy(C._bucket("date")).count().agg(F.max("count")).first()[0] <= C.BUCKET_DAYS


@pytest.mark.parametrize("name", ["W3_rolling_mean", "W12_change_vs_lag", "X1_build_features", "X8_enrich_history", "X10_window_samples", "P6_inf_to_zero"])
def test_building_a_plan_runs_no_job_but_the_footers(spark, name):
    from mktlens.plans import REGISTRY

    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", name)
    REGISTRY.queries[name].run(spark, SF01)
    jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
    tasks = sum(s.numTasks for j in jobs for i in sc.statusTracker().getJobInfo(j).stageIds if (s := sc.statusTracker().getStageInfo(i)))
    sc.setLocalProperty("spark.jobGroup.id", None)
    # reading a table's footer is a job of one task; nothing shuffles or counts
    assert tasks <= len(jobs) <= 4


def test_group_median_matches_spark_median(spark):
    """Distributed exact median == Spark's median: a hot group of continuous
    values, ties, odd/even sizes, NULLs ignored."""
    import random

    from mktlens.operators.prefix import group_median

    rnd = random.Random(7)
    rows = [("hot", rnd.random()) for _ in range(1500)] + [(f"k{i % 23}", rnd.randint(-4, 4) / 3) for i in range(900)]
    rows += [("one", 2.5), ("two", 1.0), ("two", 4.0), ("nul", None), ("nul", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median for r in group_median(df, ["k"], "v").collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want


@pytest.mark.parametrize("outliers", [[1e300], [-1e300, 1e300, float("inf")], [1e300, 1e-300, -5e-324, 0.0]])
def test_group_median_bounds_its_tasks_whatever_the_outliers(spark, outliers, monkeypatch):
    import random

    from mktlens.operators import prefix as P

    rnd = random.Random(3)
    rows = [("a", 7.0 + rnd.random()) for _ in range(6000)] + [("a", x) for x in outliers] + [("b", x) for x in outliers] + [("c", -3.0 - 1e-9 * rnd.random()) for _ in range(501)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranked = []
    closed_in = P._closed_in

    def watched(*a):
        ranked.append((closed_in(*a), [*a[2], a[4]]))
        return ranked[-1][0]

    monkeypatch.setattr(P, "_closed_in", watched)
    got = {r.k: r.median for r in P.group_median(df, ["k"], "v").collect()}
    assert got == {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    (left, middle), at = ranked[-1]
    assert left.join(middle.select(*at), at).groupBy(*at).count().agg(F.max("count")).first()[0] <= 60


def test_daily_news_median(spark):
    """The per-day news aggregate holds Spark's own median."""
    from mktlens.operators.news import daily_news_aggregates

    news = spark.createDataFrame(
        [("A", "2024-01-01", float(i % 5) / 7, 0.5) for i in range(9)] + [("B", "2024-01-02", 0.3, 1.0), ("B", "2024-01-02", -0.1, 1.0)],
        "ticker string, date string, tone double, relevance double",
    ).withColumn("date", F.to_date("date"))
    got = daily_news_aggregates(news).select("ticker", "date", "sentiment_median")
    assert rows(got) == rows(news.groupBy("ticker", "date").agg(F.median("tone")))


def test_auc_of_one_class_is_null(spark):
    from mktlens.operators.metrics import roc_auc

    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")
    assert roc_auc(df, F.col("y"), F.col("p")).first().roc_auc is None


def test_unknown_estimator_parameters_raise():
    from mktlens.config import ModelConfig
    from mktlens.operators.models import build_estimator

    with pytest.raises(ValueError, match="subsample"):
        build_estimator(ModelConfig(estimator="gradient_boosting", params={"subsample": 0.5}))


def test_news_reader_raises_unless_the_path_is_missing(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from mktlens.sources.readers import read_news

    assert read_news(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):
        read_news(spark, str(tmp_path / "empty"))
