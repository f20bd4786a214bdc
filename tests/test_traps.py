"""One test per semantic trap of the pandas original, on
literal edge rows."""
import datetime as dt
import math

from pyspark.sql import functions as F

from mktlens.config import FeatureConfig
from mktlens.functions import exprs as X
from mktlens.functions import text as TX
from mktlens.operators import bars as B
from mktlens.operators import features as FT
from mktlens.operators import metrics as M
from mktlens.operators import news as N
from mktlens.operators import samples as S

D = dt.date


def bars_df(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume double")


def test_t1_division_by_zero_is_null(spark):
    r = spark.range(1).select(X.safe_div(F.lit(1.0), F.lit(0.0)).alias("x")).first()
    assert r.x is None


def test_t2_missing_return_is_not_up(spark):
    r = spark.range(1).select(X.direction(F.lit(None).cast("double")).alias("d")).first()
    assert r.d == 0


def test_t3_std_of_one_row_is_zero_in_features(spark):
    df = bars_df(spark, [("A", D(2020, 1, 1), 10.0, 5.0), ("A", D(2020, 1, 2), 11.0, 6.0)])
    rows = B.price_features(df).orderBy("date").collect()
    assert rows[0].vol_roll_std == 0.0 and rows[1].vol_roll_std == 0.0  # one return observed -> NaN -> 0


def test_t4_t6_zero_base_price(spark):
    df = bars_df(spark, [("A", D(2020, 1, 1), 0.0, 1.0), ("A", D(2020, 1, 2), 5.0, 1.0), ("A", D(2020, 1, 3), 0.0, 1.0),
                         ("A", D(2020, 1, 4), 0.0, 1.0)])
    rows = {r.date: r for r in B.price_features(df).collect()}
    assert rows[D(2020, 1, 1)].target_return == math.inf and rows[D(2020, 1, 1)].target_direction == 1
    assert rows[D(2020, 1, 2)].return_1d == 0.0  # inf -> missing -> 0
    assert rows[D(2020, 1, 3)].target_return is None  # 0/0 -> NaN -> dropped by the train variant
    train = FT.build_features(df, None).collect()
    assert {r.date for r in train} == {D(2020, 1, 1), D(2020, 1, 2)}


def test_t7_rows_without_close_dropped_before_lag(spark):
    df = bars_df(spark, [("A", D(2020, 1, 1), 10.0, 1.0), ("A", D(2020, 1, 2), None, 1.0), ("A", D(2020, 1, 3), 20.0, 1.0)])
    rows = {r.date: r for r in B.price_features(df).collect()}
    assert D(2020, 1, 2) not in rows
    assert abs(rows[D(2020, 1, 3)].return_1d - 1.0) < 1e-12  # compared with the previous *row*


def test_t8_lag_counts_rows_not_days(spark):
    df = bars_df(spark, [("A", D(2020, 1, d), float(d), 1.0) for d in (1, 5, 20, 21, 30, 31)])
    r = B.price_features(df).where(F.col("date") == D(2020, 1, 31)).first()
    assert abs(r.return_5d - (31 / 1 - 1)) < 1e-12


def test_t9_window_sizes():
    assert (FeatureConfig(price_rolling_days=2).short_window, FeatureConfig(price_rolling_days=2).long_window) == (3, 9)
    assert (FeatureConfig(price_rolling_days=5).short_window, FeatureConfig(price_rolling_days=5).long_window) == (5, 15)


def news_df(spark, rows, cols="ticker string, date date, sentiment_score double, tone double, relevance double, language string"):
    return spark.createDataFrame(rows, cols)


def test_t10_sentiment_window_before_min_news_filter(spark):
    rows = [("A", D(2020, 1, 1), 1.0, 0.0, 0.0, "en"), ("A", D(2020, 1, 2), 0.0, 0.0, 0.0, "en"),
            ("A", D(2020, 1, 2), 0.0, 0.0, 0.0, "en")]
    agg = N.daily_news_aggregates(news_df(spark, rows), FeatureConfig(min_news_per_day=2)).collect()
    assert len(agg) == 1 and abs(agg[0].sentiment_roll_mean - 0.5) < 1e-12  # day 1 counted in the window


def test_t11_ratio_thresholds_strict(spark):
    rows = [("A", D(2020, 1, 1), s, 0.0, 0.0, "en") for s in (0.05, -0.05, 0.5, -0.5, 0.06)]
    r = N.daily_news_aggregates(news_df(spark, rows)).first()
    assert abs(r.sentiment_pos_ratio - 2 / 5) < 1e-12  # 0.5 and 0.06; 0.05 is not > 0.05
    assert abs(r.sentiment_neg_ratio - 1 / 5) < 1e-12
    assert abs(r.sentiment_extreme_ratio - 2 / 5) < 1e-12


def test_t12_exact_key_join_and_day_option(spark):
    b = spark.createDataFrame([("A", dt.datetime(2020, 1, 1, 0, 0), 1.0, 1.0), ("A", dt.datetime(2020, 1, 2, 0, 0), 2.0, 1.0)],
                              "ticker string, date timestamp_ntz, close double, volume double")
    n = spark.createDataFrame([("A", dt.datetime(2020, 1, 1, 15, 30), 0.5, 0.0, 0.0, "en")],
                              "ticker string, date timestamp_ntz, sentiment_score double, tone double, relevance double, language string")
    exact = FT.merge_features(b, n).where(F.col("news_count") > 0).count()
    by_day = FT.merge_features(b, n, normalize_day=True).where(F.col("news_count") > 0).count()
    assert exact == 0 and by_day == 1


def test_t13_inference_keeps_newest_row_with_zero_target(spark):
    df = bars_df(spark, [("A", D(2020, 1, 1), 1.0, 1.0), ("A", D(2020, 1, 2), 2.0, 1.0)])
    inf = {r.date: r for r in FT.build_features_for_inference(df, None).collect()}
    assert inf[D(2020, 1, 2)].target_return == 0.0 and FT.build_features(df, None).count() == 1


def test_t14_absent_tone_is_zero(spark):
    n = spark.createDataFrame([("A", D(2020, 1, 1), 0.3, "en")], "ticker string, date date, sentiment_score double, language string")
    r = N.daily_news_aggregates(n).first()
    assert r.tone_mean == 0.0 and r.relevance_mean == 0.0 and r.news_impact_mean == 0.0


def test_t15_empty_news_gives_zero_features(spark):
    b = bars_df(spark, [("A", D(2020, 1, 1), 1.0, 1.0), ("A", D(2020, 1, 2), 2.0, 1.0)])
    empty = news_df(spark, [])
    r = FT.build_features(b, empty).first()
    assert r.news_count == 0 and r.languages == "" and r.sentiment_mean == 0.0


def test_t16_normaliser(spark):
    df = spark.createDataFrame([("Größe",), ("苹果",), ("Ёлка, AT&T",), ("!!!",)], "t string")
    out = [r.n for r in df.select(TX.normalise("t").alias("n")).collect()]
    assert out == ["gr e", "", "ёлка at t", ""]


def test_t23_clip_keeps_missing(spark):
    r = spark.range(1).select(X.clip_lower(F.lit(None).cast("double"), 0.0).alias("a"), X.clip_lower(F.lit(-2.0), 0.0).alias("b")).first()
    assert r.a is None and r.b == 0.0


def test_t24_strict_window_needs_full_frame(spark):
    df = bars_df(spark, [("A", D(2020, 1, d), float(d), 1.0) for d in range(1, 6)])
    out = {r.date: r.ma_3 for r in B.enrich_history(df, 3).collect()}
    assert out[D(2020, 1, 2)] is None and out[D(2020, 1, 3)] == 2.0


def test_t25_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    h = {r.bin: r["count"] for r in M.histogram(df, "v", None, 10).collect()}
    assert h[9] == 2 and sum(h.values()) == 11


def test_t26_lenient_numbers(spark):
    from mktlens.sources.readers import conform_prices

    raw = spark.createDataFrame([("A", "2020-01-01", "abc", "5"), ("A", "2020-01-02T00:00:00Z", "3.5", "x")],
                                "ticker string, date string, Close string, Volume string")
    rows = conform_prices(raw).orderBy("date").collect()
    assert rows[0].close is None and rows[1].close == 3.5 and rows[1].volume is None
    assert rows[1].date == dt.datetime(2020, 1, 2)


def test_t27_strip_all_whitespace(spark):
    r = spark.range(1).select(X.strip_ws(F.lit("\t en \n")).alias("s")).first()
    assert r.s == "en"


def test_t28_short_series_no_windows(spark):
    df = spark.createDataFrame([("A", D(2020, 1, 1) + dt.timedelta(days=i), float(i), 0) for i in range(99)],
                               "ticker string, date date, v double, y int")
    assert S.window_samples(df, "v", "y", length=100, step=10).count() == 0


def test_t28_window_counts(spark):
    for n, k in ((100, 1), (109, 1), (110, 2), (300, 21)):
        df = spark.createDataFrame([("A", D(2000, 1, 1) + dt.timedelta(days=i), float(i), i) for i in range(n)],
                                   "ticker string, date date, v double, y int")
        w = S.window_samples(df, "v", "y", length=100, step=10).orderBy("window_no").collect()
        assert len(w) == k
        assert w[-1]["values"][0] == float(10 * (k - 1)) and w[-1].label == 10 * (k - 1) + 99


def test_t29_optional_lines_skipped(spark):
    from mktlens.operators.report import explanation

    r = spark.range(1).select(explanation(F.lit(None).cast("double"), F.lit(None).cast("double"),
                                          F.lit(None).cast("double")).alias("e")).first()
    assert r.e.startswith("Недостаточно данных")


def test_t31_null_ticker_dropped(spark):
    df = bars_df(spark, [(None, D(2020, 1, 1), 1.0, 1.0), ("A", D(2020, 1, 1), 1.0, 1.0)])
    assert B.price_features(df).count() == 1
