"""Queries: sources and sinks (S1-S4, S7, S10-S13, S15, S16, S18), the
remaining projections/predicates (P1-P7, P11, P12, P20, P21, P23, P24), the
feature-matrix parts (A1-A5, J1, J2, X3, F6-F8), sorts (O1, O7-O9) and the
training run (X7)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from mktlens.config import FeatureConfig, ModelConfig
from mktlens.functions.exprs import finite, forward_return, zero_if_null
from mktlens.functions.sentiment import FIXTURE_LEXICON, lexicon_score, sentiment_label
from mktlens.operators import bars as B
from mktlens.operators import entity as E
from mktlens.operators import features as X
from mktlens.operators import language as L
from mktlens.operators import models as MD
from mktlens.operators import news as N
from mktlens.operators.chunked import apply_windows
from mktlens.plans.q_entity import J3_CTES, X11_BODY, x11_company_news
from mktlens.plans.q_features import annotated_news, x1_build_features
from mktlens.plans.q_metrics import X1_CTES
from mktlens.plans.q_models import scratch
from mktlens.plans.q_windows import LABEL_CTES, labelled_history
from mktlens.plans.registry import register, with_ctes
from mktlens.plans.sqlparts import FEATURE_DOUBLES, news_aggregates_sql, price_features_sql, feature_matrix_sql
from mktlens.sources import fixtures as fx
from mktlens.sources import readers as RD

AS_OF = "1996-10-01"
FEAT_CTES = (fx.BARS_SQL, fx.NEWS_SQL, fx.ANNOTATED_SQL, price_features_sql(), news_aggregates_sql())


# ---------------------------------------------------------------- S1 / P1-P4
RAW_PRICES_SQL = """rawp AS (
  SELECT ticker, strftime(date, '%Y-%m-%d') || CASE WHEN CAST(round(close * 100) AS BIGINT) % 5 = 0 THEN 'T00:00:00Z' ELSE '' END AS date_s,
         CASE WHEN CAST(round(close * 100) AS BIGINT) % 97 = 0 THEN 'n/a' ELSE CAST(close AS VARCHAR) END AS Close,
         CASE WHEN CAST(volume AS BIGINT) % 89 = 0 THEN NULL ELSE CAST(volume AS VARCHAR) END AS Volume
  FROM bars)"""


def raw_prices(spark, sf_dir):
    """Price rows as text, the way a CSV delivers them: some closes are not
    numbers, some volumes are missing, some dates carry a zone suffix."""
    b = fx.bars(spark, sf_dir)
    cents = F.round(F.col("close") * 100).cast("bigint")
    date_s = F.concat(F.date_format("date", "yyyy-MM-dd"), F.when(cents % 5 == 0, F.lit("T00:00:00Z")).otherwise(F.lit("")))
    return b.select(
        "ticker",
        date_s.alias("date"),
        F.when(cents % 97 == 0, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("Close"),
        F.when(F.col("volume").cast("bigint") % 89 == 0, F.lit(None).cast("string")).otherwise(F.col("volume").cast("string")).alias("Volume"),
    )


CONFORMED_SQL = """conf AS (
  SELECT ticker, TRY_CAST(regexp_replace(date_s, '(Z|[+-]\\d\\d:?\\d\\d)$', '') AS TIMESTAMP) AS date,
         TRY_CAST(Close AS DOUBLE) AS close, TRY_CAST(Volume AS DOUBLE) AS volume
  FROM rawp WHERE ticker IS NOT NULL)"""


@register("S1_price_intake", sql=with_ctes(fx.BARS_SQL, RAW_PRICES_SQL, CONFORMED_SQL, body="SELECT * FROM conf"), dbl=("close", "volume"))
def s1_price_intake(spark, sf_dir):
    """Conform text price rows: Close/close pick, lenient numbers, parsed dates."""
    return RD.conform_prices(raw_prices(spark, sf_dir))


@register("P1_timestamp_parse", sql=with_ctes(fx.BARS_SQL, RAW_PRICES_SQL, body="""SELECT date_s,
  TRY_CAST(regexp_replace(date_s, '(Z|[+-]\\d\\d:?\\d\\d)$', '') AS TIMESTAMP) AS parsed FROM (
  SELECT date_s FROM rawp UNION ALL SELECT 'not a date' UNION ALL SELECT '1996-02-30' UNION ALL SELECT date_s || '+03:00' FROM rawp WHERE ticker = 'Brand#1')"""))
def p1_timestamp_parse(spark, sf_dir):
    """Lenient timestamp parse with the zone suffix dropped; bad input -> NULL."""
    r = raw_prices(spark, sf_dir)
    extra = spark.createDataFrame([("not a date",), ("1996-02-30",)], "date string")
    s = r.select("date").unionByName(extra).unionByName(r.where(F.col("ticker") == "Brand#1").select(F.concat("date", F.lit("+03:00")).alias("date")))
    return s.select(F.col("date").alias("date_s"), RD.parse_ts(F.col("date")).alias("parsed"))


@register("P2_column_fallback", sql=with_ctes(fx.BARS_SQL, body="""SELECT ticker, date, close, 'Close' AS picked FROM bars WHERE ticker < 'Brand#2'
UNION ALL SELECT ticker, date, close * 2, 'close' FROM bars WHERE ticker >= 'Brand#2'"""), dbl=("close",))
def p2_column_fallback(spark, sf_dir):
    """First existing column of (Close, close) is used (two inputs: one per spelling)."""
    b = fx.bars(spark, sf_dir)
    upper = b.where(F.col("ticker") < "Brand#2").select("ticker", "date", F.col("close").alias("Close"), (F.col("close") * 3).alias("adj"))
    lower = b.where(F.col("ticker") >= "Brand#2").select("ticker", "date", (F.col("close") * 2).alias("close"), (F.col("close") * 3).alias("adj"))
    out = []
    for frame in (upper, lower):
        c = RD.pick(frame, "Close", "close")
        name = "Close" if "Close" in frame.columns else "close"
        out.append(frame.select("ticker", "date", c.alias("close"), F.lit(name).alias("picked")))
    return out[0].unionByName(out[1])


@register("P3_lenient_cast", sql=with_ctes(fx.BARS_SQL, RAW_PRICES_SQL, body="SELECT ticker, date_s, TRY_CAST(Close AS DOUBLE) AS close FROM rawp"), dbl=("close",))
def p3_lenient_cast(spark, sf_dir):
    """Text -> double, unparsable -> NULL."""
    r = raw_prices(spark, sf_dir)
    return r.select("ticker", F.col("date").alias("date_s"), RD.lenient_double(F.col("Close")).alias("close"))


@register("P4_drop_nulls", sql=with_ctes(fx.BARS_SQL, RAW_PRICES_SQL, CONFORMED_SQL, body="SELECT * FROM conf WHERE close IS NOT NULL AND volume IS NOT NULL"),
          dbl=("close", "volume"))
def p4_drop_nulls(spark, sf_dir):
    """Rows null in (close, volume) dropped."""
    return RD.conform_prices(raw_prices(spark, sf_dir)).na.drop(subset=["close", "volume"])


@register("P5_null_fill", sql=with_ctes(fx.BARS_SQL, RAW_PRICES_SQL, CONFORMED_SQL,
                                        body="SELECT ticker, date, coalesce(close, 0.0) AS close, coalesce(volume, -1.0) AS volume FROM conf"),
          dbl=("close", "volume"))
def p5_null_fill(spark, sf_dir):
    """Per-column null fill."""
    return RD.conform_prices(raw_prices(spark, sf_dir)).na.fill({"close": 0.0, "volume": -1.0})


@register("P6_inf_to_zero", sql=with_ctes(fx.BARS_SQL, RAW_PRICES_SQL, CONFORMED_SQL, body="""SELECT ticker, date,
  coalesce(CASE WHEN abs(r) < CAST('inf' AS DOUBLE) THEN r END, 0.0) AS ret,
  coalesce(vm, volume) AS volume_mean
FROM (SELECT ticker, date, volume,
             CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1
                  WHEN close > 0 THEN CAST('inf' AS DOUBLE) WHEN close < 0 THEN CAST('-inf' AS DOUBLE) END AS r,
             avg(volume) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS vm
      FROM conf WHERE close IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date))"""), dbl=("ret", "volume_mean"))
def p6_inf_to_zero(spark, sf_dir):
    """Infinite / missing ratios -> 0, volume mean falls back to volume."""
    c = RD.conform_prices(raw_prices(spark, sf_dir)).where(F.col("close").isNotNull())

    def build(b, w):
        r = forward_return(F.lag("close").over(w), F.col("close"))
        vm = F.avg("volume").over(w.rowsBetween(-2, 0))
        keep = [k for k in b.columns if k.startswith("_")]
        return b.select("ticker", "date", zero_if_null(finite(r)).alias("ret"), F.coalesce(vm, F.col("volume")).alias("volume_mean"), *keep)

    return apply_windows(c, build, lookback=2)


@register("P7_feed_projection", sql=with_ctes(fx.NEWS_SQL, fx.FEED_SQL, body="""SELECT 'FEED' AS ticker, TRY_CAST(published_at AS TIMESTAMP) AS seen_datetime,
  CAST(TRY_CAST(published_at AS TIMESTAMP) AS DATE) AS date, coalesce(title, '') AS title, coalesce(summary, '') AS full_text,
  link AS url, coalesce(language, '') AS language, source_name AS source FROM feed"""))
def p7_feed_projection(spark, sf_dir):
    """Feed -> news renames with a constant ticker."""
    f = RD.conform_feed(fx.feed(spark, sf_dir)).withColumn("item_id", F.col("doc_id"))
    return E.local_news(f, f.select("item_id", F.lit("FEED").alias("symbol")))


# ---------------------------------------------------------------- S2 / S3 / S4 / S7
@register("S2_feature_table_read", sql=with_ctes(*X1_CTES, body="SELECT * REPLACE (CAST(date AS TIMESTAMP) AS date, nullif(languages, '') AS languages) FROM x1"),
          dbl=FEATURE_DOUBLES)
def s2_feature_table_read(spark, sf_dir):
    """Feature matrix written as CSV and read back (dates parsed, bad dates dropped; CSV has no empty text)."""
    path = scratch(spark, "features-csv")
    x1_build_features(spark, sf_dir).write.option("header", True).mode("overwrite").csv(path)
    f = RD.read_features(spark, path, "csv")
    return f.withColumn("languages", F.when(F.col("languages") != "", F.col("languages")))


@register("S3_news_table_read", sql=with_ctes(fx.NEWS_SQL, body="""SELECT doc_id, ticker, title, url,
  seen_datetime - to_minutes(CASE doc_id % 3 WHEN 1 THEN 180 WHEN 2 THEN -330 ELSE 0 END) AS seen_datetime,
  CAST(date AS TIMESTAMP) AS date, CAST(NULL AS VARCHAR) AS tagged_by FROM news"""))
def s3_news_table_read(spark, sf_dir):
    """News table written and read back, its times given with offsets and read as UTC; a missing path adds nothing."""
    path = scratch(spark, "news")
    zone = F.when(F.col("doc_id") % 3 == 1, "+03:00").when(F.col("doc_id") % 3 == 2, "-0530").otherwise("Z")
    text = F.concat(F.date_format("seen_datetime", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    fx.news(spark, sf_dir).withColumn("seen_datetime", text).write.mode("overwrite").parquet(path)
    names = ["ticker", "title", "url", "seen_datetime", "date"]
    n = RD.read_news(spark, path).select("doc_id", *names)
    missing = RD.read_news(spark, path + "-absent").select(*names)
    u = n.unionByName(missing, allowMissingColumns=True)
    return u.withColumn("tagged_by", F.lit(None).cast("string"))


@register("S4_feed_read", sql=with_ctes(fx.NEWS_SQL, fx.FEED_SQL, body="""SELECT TRY_CAST(published_at AS TIMESTAMP) AS published_at,
  coalesce(title, '') AS title, coalesce(summary, '') AS summary, link, source_name, language
FROM feed WHERE TRY_CAST(published_at AS TIMESTAMP) IS NOT NULL"""))
def s4_feed_read(spark, sf_dir):
    """JSON-lines feed read with a fixed schema: zone dropped, rows without a time dropped, blanks filled."""
    path = scratch(spark, "feed-json")
    fx.feed(spark, sf_dir).drop("doc_id").write.mode("overwrite").json(path)
    return RD.read_feed(spark, path)


@register("S7_persist_features", sql=with_ctes(*X1_CTES, body="SELECT * FROM x1"), dbl=FEATURE_DOUBLES)
def s7_persist_features(spark, sf_dir):
    """Features persisted by month, ranged by (date, ticker), and read back."""
    path = scratch(spark, "features-parquet")
    x = x1_build_features(spark, sf_dir)
    RD.write_by_period(x, path)
    return RD.read_periods(spark, path, schema=x.schema).select(*x.columns)


@register("S7_recent_features", sql=with_ctes(*X1_CTES, body=f"SELECT * FROM x1 WHERE date BETWEEN DATE '{AS_OF}' - 60 AND DATE '{AS_OF}'"), dbl=FEATURE_DOUBLES)
def s7_recent_features(spark, sf_dir):
    """Features persisted by month, the last 60 days read back from their months' folders."""
    path = scratch(spark, "features-by-month")
    x = x1_build_features(spark, sf_dir)
    RD.write_by_period(x, path)
    since = str(dt.date.fromisoformat(AS_OF) - dt.timedelta(days=60))
    return RD.read_periods(spark, path, since, AS_OF, schema=x.schema).select(*x.columns)


# ---------------------------------------------------------------- S10 / S11 / S12 / S13
FILE_SQL = "CAST(substr(ticker, 7) AS INTEGER) % 3"


def history_files(spark, sf_dir):
    """History CSV files, their columns in different orders, one without volume: their paths."""
    root = scratch(spark, "history")
    b = fx.bars(spark, sf_dir).select((F.substring("ticker", 7, 10).cast("int") % 3).alias("file_no"), F.col("ticker").alias("Ticker"),
                                      F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    headers = [("Date", "Ticker", "Close", "Volume"), ("Ticker", "Date", "Close"), ("Ticker", "Volume", "Date", "Close")]
    paths = [f"{root}/part_{k}" for k in range(3)]
    for k, names in enumerate(headers):
        b.where(F.col("file_no") == k).select(*names).write.option("header", True).mode("overwrite").csv(paths[k])
    return paths


def file_no():
    return F.regexp_extract("source_file", r"part_(\d+)/", 1).cast("int").alias("file_no")


@register("S10_history_files", sql=with_ctes(fx.BARS_SQL, body=f"""SELECT {FILE_SQL} AS file_no, ticker AS Ticker, strftime(date, '%Y-%m-%d') AS Date,
  close, CASE WHEN {FILE_SQL} <> 1 THEN volume END AS volume FROM bars"""), dbl=("close", "volume"))
def s10_history_files(spark, sf_dir):
    """History files with their columns in different orders, one without volume, united by name."""
    h = RD.read_history_files(spark, history_files(spark, sf_dir))
    return h.select(file_no(), "Ticker", "Date", F.col("Close").cast("double").alias("close"), F.col("Volume").cast("double").alias("volume"))


@register("S10_running_tickers", sql=with_ctes(fx.BARS_SQL, f"""f AS (
  SELECT {FILE_SQL} AS file_no, ticker FROM bars UNION ALL SELECT 3 + {FILE_SQL}, 'X' || ticker FROM bars WHERE volume > 30 UNION ALL SELECT 3 + {FILE_SQL}, ticker FROM bars),
firsts AS (SELECT ticker, min(file_no) AS file_no FROM f GROUP BY ticker)""", body="""SELECT file_no, n_rows, coalesce(c, 0) AS new,
  CAST(sum(coalesce(c, 0)) OVER (ORDER BY file_no) AS BIGINT) AS so_far
FROM (SELECT file_no, count(*) AS n_rows FROM f GROUP BY file_no) LEFT JOIN (SELECT file_no, count(*) AS c FROM firsts GROUP BY file_no) USING (file_no)"""))
def s10_running_tickers(spark, sf_dir):
    """Rows, new tickers and distinct tickers so far, file by file, over history read twice with some new names."""
    from mktlens.operators.ingest import running_distinct

    h = RD.read_history_files(spark, history_files(spark, sf_dir)).select(file_no(), "Ticker")
    b = fx.bars(spark, sf_dir).withColumn("file_no", F.substring("ticker", 7, 10).cast("int") % 3 + 3)
    again = b.select("file_no", F.col("ticker").alias("Ticker"))
    renamed = b.where("volume > 30").select("file_no", F.concat(F.lit("X"), "ticker").alias("Ticker"))
    return running_distinct(h.unionByName(again).unionByName(renamed), "file_no", "Ticker")


@register("S11_wide_to_long", sql=with_ctes(fx.BARS_SQL, body="SELECT date, ticker, close AS Close, volume AS Volume FROM bars"), dbl=("Close", "Volume"))
def s11_wide_to_long(spark, sf_dir):
    """Wide (date x ticker|field) table of all tickers reshaped back to long rows; all-missing rows dropped."""
    b = fx.bars(spark, sf_dir)
    brands = fx.table(spark, sf_dir, "part").select("p_brand").distinct()
    # the columns of a wide table are its schema, which the driver holds in any case
    tickers = sorted(r[0] for r in brands.collect())
    wide = b.groupBy("date").pivot("ticker", tickers).agg(F.first("close").alias("Close"), F.first("volume").alias("Volume"))
    wide = wide.select("date", *[F.col(f"`{t}_{f}`").alias(f"{t}|{f}") for t in tickers for f in ("Close", "Volume")])
    long = RD.wide_to_long(wide, "date", tickers, ["Close", "Volume"])
    return long.where(F.col("Close").isNotNull() | F.col("Volume").isNotNull())


OLD_SQL = """old AS (SELECT * FROM bars WHERE date <= DATE '1998-01-01' AND ticker <> 'Brand#2'
  UNION ALL SELECT * FROM bars WHERE date <= DATE '1997-01-01' AND ticker = 'Brand#2'),
hw AS (SELECT ticker, max(date) AS hw FROM old GROUP BY ticker)"""


def old_bars(spark, sf_dir):
    """A table to append to: one ticker ends a year before the others."""
    b = fx.bars(spark, sf_dir)
    return b, b.where((F.col("date") <= F.lit("1998-01-01").cast("date")) & (F.col("ticker") != "Brand#2")).unionByName(
        b.where((F.col("date") <= F.lit("1997-01-01").cast("date")) & (F.col("ticker") == "Brand#2")))


@register("S12_incremental_append", sql=with_ctes(fx.BARS_SQL, OLD_SQL, body="""SELECT * FROM old
UNION ALL SELECT * FROM bars WHERE date >= (SELECT max(date) FROM old) + 1"""), dbl=("close", "volume"))
def s12_incremental_append(spark, sf_dir):
    """Append the rows from the table's last date + 1 day on."""
    from mktlens.operators.ingest import append_new_rows

    b, old = old_bars(spark, sf_dir)
    return append_new_rows(old, b)


@register("S12_incremental_append_per_ticker", sql=with_ctes(fx.BARS_SQL, OLD_SQL, body="""SELECT * FROM old
UNION ALL SELECT b.* FROM bars b JOIN hw USING (ticker) WHERE b.date >= hw.hw + 1
UNION ALL SELECT * FROM bars WHERE date >= (SELECT max(date) FROM old) + 1 AND ticker NOT IN (SELECT ticker FROM hw)"""), dbl=("close", "volume"))
def s12_incremental_append_per_ticker(spark, sf_dir):
    """Append rows above each ticker's own last date (new tickers above the table's)."""
    from mktlens.operators.ingest import append_new_rows

    b, old = old_bars(spark, sf_dir)
    return append_new_rows(old, b, per_key=True)


@register("S13_ticker_batches", sql=with_ctes(fx.BARS_SQL, body="""SELECT ticker, CAST(floor((rn - 1) / 10) AS INTEGER) AS batch FROM (
  SELECT ticker, row_number() OVER (ORDER BY ticker) AS rn FROM (SELECT DISTINCT ticker FROM bars))
WHERE floor((rn - 1) / 10) >= 1"""))
def s13_ticker_batches(spark, sf_dir):
    """Distinct tickers in chunks of 10, resumed from chunk 1."""
    from mktlens.operators.ingest import ticker_batches

    return ticker_batches(fx.bars(spark, sf_dir), 10, from_chunk=1)


# ---------------------------------------------------------------- S15 / S16 / S18
SOURCES_SQL = """sources AS (
  SELECT source AS id, 'Source ' || source AS name, 'feed://' || source AS url, arg_max(lang, (cnt, lang)) AS language,
         list_sort(list(lang)) AS tags
  FROM (SELECT source, lang, count(*) AS cnt FROM documents GROUP BY source, lang) GROUP BY source)"""


@register("S15_news_sources", sql=with_ctes(SOURCES_SQL, body="SELECT * FROM sources WHERE id IN ('src0', 'src3', 'src7', 'src99')"))
def s15_news_sources(spark, sf_dir):
    """News-source catalogue derived from the documents, filtered by requested ids."""
    from mktlens.operators.ingest import filter_sources, source_catalogue

    cat = source_catalogue(fx.table(spark, sf_dir, "documents"))
    ids = spark.createDataFrame([("src0",), ("src3",), ("src7",), ("src99",)], "id string")
    return filter_sources(cat, ids)


PERIOD_START, PERIOD_END = "1996-01-01", "1996-10-01"
QUERY_TERMS = ["the", "tion", "ent", "que", "der"]
TERMS_SQL = f"""tick AS (SELECT DISTINCT ticker FROM news WHERE ticker IS NOT NULL),
qterms AS (SELECT ticker, term FROM (SELECT ticker, unnest([ticker, {QUERY_TERMS}[CAST(substr(ticker, 7) AS INTEGER) % 5 + 1], {QUERY_TERMS}[(CAST(substr(ticker, 7) AS INTEGER) + 2) % 5 + 1]]) AS term FROM tick)),
win AS (SELECT ticker, term, unnest(generate_series(DATE '{PERIOD_START}', DATE '{PERIOD_END}', INTERVAL 7 DAY)) AS ws FROM qterms),
w2 AS (SELECT ticker, term, CAST(ws AS DATE) AS window_start, CAST(least(ws + INTERVAL 6 DAY, DATE '{PERIOD_END}') AS DATE) AS window_end FROM win)"""


def query_terms(news):
    """(ticker, term): the symbol and two words."""
    number = F.substring("ticker", 7, 10).cast("int")
    words = F.array(*[F.lit(t) for t in QUERY_TERMS])
    pick = lambda k: F.element_at(words, ((number + k) % 5 + 1).cast("int"))
    return news.select("ticker").where("ticker is not null").distinct().select("ticker", F.explode(F.array("ticker", pick(0), pick(2))).alias("term"))


@register("S16_query_windows", sql=with_ctes(fx.NEWS_SQL, TERMS_SQL, body="SELECT * FROM w2"))
def s16_query_windows(spark, sf_dir):
    """Query plan: 7-day windows per ticker and term over the period."""
    from mktlens.operators.ingest import query_windows

    return query_windows(query_terms(fx.news(spark, sf_dir)), PERIOD_START, PERIOD_END, 7)


@register("S16_news_query_plan", sql=with_ctes(fx.NEWS_SQL, TERMS_SQL, """hits AS (
  SELECT w2.ticker, w2.term, w2.window_start, w2.window_end, n.doc_id, n.title, n.url, n.seen_datetime,
         row_number() OVER (PARTITION BY w2.ticker, w2.term, w2.window_start ORDER BY n.seen_datetime DESC, n.doc_id) AS rn
  FROM w2 JOIN news n ON n.ticker = w2.ticker AND n.date BETWEEN w2.window_start AND w2.window_end
       AND contains(lower(n.title || ' ' || n.full_text), lower(w2.term)))""",
    body="""SELECT ticker, window_start, window_end, doc_id, list_sort(list(term)) AS terms, title, url, seen_datetime
FROM hits WHERE rn <= 3 GROUP BY ticker, window_start, window_end, doc_id, title, url, seen_datetime"""))
def s16_news_query_plan(spark, sf_dir):
    """What the plan finds: per ticker, term and 7-day window the newest 3 items, terms united, a row per item."""
    from mktlens.operators.ingest import window_items

    n = fx.news(spark, sf_dir).select("ticker", "doc_id", "date", "seen_datetime", "title", "url", "full_text")
    found = window_items(n, query_terms(n), PERIOD_START, PERIOD_END, 7, 3, F.concat("title", F.lit(" "), "full_text"))
    return found.select("ticker", "window_start", "window_end", "doc_id", "terms", "title", "url", "seen_datetime")


@register("S18_quick_train_window", sql=with_ctes(fx.BARS_SQL, fx.NEWS_SQL, body=f"""SELECT 'prices' AS kind, ticker, date, close, CAST(NULL AS BIGINT) AS doc_id FROM bars
  WHERE date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}'
UNION ALL SELECT 'news', ticker, date, NULL, doc_id FROM news WHERE date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}'"""), dbl=("close",))
def s18_quick_train_window(spark, sf_dir):
    """Both date ranges rewritten to the last 90 days before as_of: the rows that are left."""
    from mktlens.operators.ingest import last_days

    as_of = F.lit(AS_OF).cast("date")
    p = last_days(fx.bars(spark, sf_dir), as_of, 90).select(F.lit("prices").alias("kind"), "ticker", "date", "close", F.lit(None).cast("long").alias("doc_id"))
    n = last_days(fx.news(spark, sf_dir), as_of, 90).select(F.lit("news").alias("kind"), "ticker", "date", F.lit(None).cast("double").alias("close"), F.col("doc_id").cast("long"))
    return p.unionByName(n)


# ---------------------------------------------------------------- A1-A5 / J1 / J2 / P11 / P12
AGG_COLS = {
    "A1_sentiment_stats": ["sentiment_mean", "sentiment_std", "sentiment_median"],
    "A2_sentiment_shares": ["sentiment_pos_ratio", "sentiment_neg_ratio", "sentiment_extreme_ratio"],
    "A3_news_count": ["news_count"],
    "A4_tone_relevance_impact": ["tone_mean", "relevance_mean", "news_impact_mean"],
    "A5_languages": ["languages", "languages_count"],
}
AGG_DOCS = {
    "A1_sentiment_stats": "Mean, sample std (0 for one item) and median sentiment per (ticker, date).",
    "A2_sentiment_shares": "Shares of items above 0.05, below -0.05 and with |score| >= 0.5.",
    "A3_news_count": "Items per (ticker, date).",
    "A4_tone_relevance_impact": "Mean tone, relevance and tone x relevance.",
    "A5_languages": "Sorted distinct non-blank languages (detected ∪ given) and their count.",
}


def _agg_query(name, cols):
    dbl = tuple(c for c in cols if c not in ("news_count", "languages", "languages_count"))

    def fn(spark, sf_dir):
        agg = N.daily_news_aggregates(annotated_news(spark, sf_dir), FeatureConfig(min_news_per_day=0))
        return agg.select("ticker", "date", *cols)

    fn.__doc__ = AGG_DOCS[name]
    register(name, sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, news_aggregates_sql(),
                                 body=f"SELECT ticker, date, {', '.join(cols)} FROM nagg"), dbl=dbl)(fn)


for _n, _c in AGG_COLS.items():
    _agg_query(_n, _c)

NAGG_DBL = ("sentiment_mean", "sentiment_std", "sentiment_median", "sentiment_pos_ratio", "sentiment_neg_ratio",
            "sentiment_extreme_ratio", "tone_mean", "relevance_mean", "news_impact_mean", "sentiment_roll_mean")


@register("J2_single_aggregate", sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, news_aggregates_sql(), body="SELECT * FROM nagg WHERE news_count >= 1"),
          dbl=NAGG_DBL)
def j2_single_aggregate(spark, sf_dir):
    """All per-(ticker, date) news aggregates from one group-by (no recombining joins)."""
    return N.daily_news_aggregates(annotated_news(spark, sf_dir), FeatureConfig())


@register("P12_min_news_filter", sql=with_ctes(*J3_CTES, f"x11 AS (SELECT *, 0.0 AS tone, 0.0 AS relevance FROM ({X11_BODY}))", news_aggregates_sql("x11"),
                                               body="SELECT ticker, date, news_count, sentiment_roll_mean FROM nagg WHERE news_count >= 40"),
          dbl=("sentiment_roll_mean",))
def p12_min_news_filter(spark, sf_dir):
    """Days with at least 40 items of a company's news, rolling mean taken before the filter."""
    agg = N.daily_news_aggregates(x11_company_news(spark, sf_dir), FeatureConfig(min_news_per_day=40))
    return agg.select("ticker", "date", "news_count", "sentiment_roll_mean")


@register("P11_news_impact", sql=with_ctes(fx.NEWS_SQL, body="SELECT doc_id, tone * relevance AS news_impact FROM news"), dbl=("news_impact",))
def p11_news_impact(spark, sf_dir):
    """news_impact = tone x relevance."""
    n = fx.news(spark, sf_dir)
    return n.select("doc_id", (F.col("tone") * F.col("relevance")).alias("news_impact"))


J1_BODY = """SELECT p.ticker, p.date, p.close, p.volume, p.return_1d, p.return_5d, p.vol_roll_std, p.sma_ratio,
  p.volume_roll_mean, p.volume_zscore, p.target_return, CAST(coalesce(p.target_return > 0, false) AS INTEGER) AS target_direction,
  coalesce(n.sentiment_mean, 0.0) AS sentiment_mean, coalesce(n.sentiment_std, 0.0) AS sentiment_std,
  coalesce(n.sentiment_median, 0.0) AS sentiment_median, coalesce(n.sentiment_pos_ratio, 0.0) AS sentiment_pos_ratio,
  coalesce(n.sentiment_neg_ratio, 0.0) AS sentiment_neg_ratio, coalesce(n.sentiment_extreme_ratio, 0.0) AS sentiment_extreme_ratio,
  coalesce(n.news_count, 0) AS news_count, coalesce(n.tone_mean, 0.0) AS tone_mean, coalesce(n.relevance_mean, 0.0) AS relevance_mean,
  coalesce(n.news_impact_mean, 0.0) AS news_impact_mean, coalesce(n.languages, '') AS languages,
  coalesce(n.languages_count, 0) AS languages_count, coalesce(n.sentiment_roll_mean, 0.0) AS sentiment_roll_mean
FROM price p LEFT JOIN (SELECT * FROM nagg WHERE news_count >= 1) n ON p.ticker = n.ticker AND p.date = n.date"""


@register("J1_price_news_join", sql=with_ctes(*FEAT_CTES, body=J1_BODY), dbl=FEATURE_DOUBLES)
def j1_price_news_join(spark, sf_dir):
    """Price features ⟕ news aggregates on (ticker, date), unmatched news columns zero-filled."""
    return X.merge_features(fx.bars(spark, sf_dir), annotated_news(spark, sf_dir))


# ---------------------------------------------------------------- X3 / F6 / F7 / F8
@register("X3_annotate_news", sql=with_ctes(fx.NEWS_SQL, fx.ANNOTATED_SQL, body="SELECT doc_id, sentiment_score, sentiment_label, detected_language FROM annotated"),
          dbl=("sentiment_score",))
def x3_annotate_news(spark, sf_dir):
    """Sentiment score, label and detected language columns added to news."""
    return annotated_news(spark, sf_dir).select("doc_id", "sentiment_score", "sentiment_label", "detected_language")


@register("F6_lexicon_score", sql=with_ctes(body=f"SELECT doc_id, {fx.lexicon_score_sql('text')} AS score FROM documents"), dbl=("score",))
def f6_lexicon_score(spark, sf_dir):
    """Lexicon sentiment over whole documents: (pos - neg) / (pos + neg), each term once."""
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", lexicon_score("text", FIXTURE_LEXICON).alias("score"))


@register("F7_sentiment_label", sql=with_ctes(body=f"SELECT doc_id, {fx.label_sql('(' + fx.lexicon_score_sql('text') + ')')} AS label FROM documents"))
def f7_sentiment_label(spark, sf_dir):
    """Label at +-0.1."""
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", sentiment_label(lexicon_score("text", FIXTURE_LEXICON)).alias("label"))


F8_SQL = """tri AS (SELECT lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS trigram
              FROM (SELECT lang, string_split(lower(text), '') AS c FROM documents WHERE lang IS NOT NULL)),
cnt AS (SELECT lang, trigram, count(*) AS c FROM tri GROUP BY ALL),
tot AS (SELECT lang, sum(c) AS total, (SELECT count(DISTINCT trigram) FROM cnt) AS v FROM cnt GROUP BY lang),
prof AS (SELECT c.lang, c.trigram, ln((c.c + 1) / (t.total + t.v)) AS logp, ln(1 / (t.total + t.v)) AS log_unseen FROM cnt c JOIN tot t USING (lang)),
dtri AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS trigram
         FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), '') AS c FROM documents)),
dc AS (SELECT doc_id, trigram, count(*) AS cnt FROM dtri GROUP BY ALL),
dn AS (SELECT doc_id, sum(cnt) AS n FROM dc GROUP BY doc_id),
base AS (SELECT dn.doc_id, l.lang, dn.n * l.log_unseen AS s0 FROM dn, (SELECT DISTINCT lang, log_unseen FROM prof) l),
hit AS (SELECT dc.doc_id, p.lang, sum(dc.cnt * (p.logp - p.log_unseen)) AS s1 FROM dc JOIN prof p USING (trigram) GROUP BY ALL),
sc AS (SELECT b.doc_id, b.lang, b.s0 + coalesce(h.s1, 0.0) AS score FROM base b LEFT JOIN hit h USING (doc_id, lang))"""


@register("F8_language_tag", sql=with_ctes(F8_SQL, body="""SELECT d.doc_id, b.detected_language FROM documents d LEFT JOIN (
  SELECT doc_id, arg_max(lang, (score, lang)) AS detected_language FROM sc GROUP BY doc_id) b USING (doc_id)"""))
def f8_language_tag(spark, sf_dir):
    """Character-trigram naive Bayes language tag trained from the labelled documents."""
    d = fx.table(spark, sf_dir, "documents")
    prof = L.train_profiles(d, "text", "lang")
    return L.tag_language(d, prof, "doc_id", "text")


# ---------------------------------------------------------------- P20 / P21 / P23 / P24
@register("P20_model_matrix", sql=with_ctes(*X1_CTES, body="SELECT ticker, date, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in X.MODEL_FEATURES) + ", 0.0 AS analyst_rating FROM x1"),
    dbl=tuple(X.MODEL_FEATURES) + ("analyst_rating",))
def p20_model_matrix(spark, sf_dir):
    """Reindex to the model's columns (an absent one becomes 0.0), numerics as double."""
    return X.model_matrix(x1_build_features(spark, sf_dir), X.MODEL_FEATURES + ["analyst_rating"])


@register("P21_label_remap", sql=with_ctes(fx.SCORES_SQL, body="""SELECT l_orderkey, l_linenumber, lab AS raw_label,
  CASE WHEN lab = -1 THEN 0 ELSE lab END AS label FROM (SELECT *, CASE WHEN y = 2 THEN -1 ELSE y END AS lab FROM scores)"""))
def p21_label_remap(spark, sf_dir):
    """Label -1 mapped to 0."""
    s = fx.scores(spark, sf_dir).withColumn("raw_label", F.when(F.col("y") == 2, -1).otherwise(F.col("y")))
    return s.select("l_orderkey", "l_linenumber", "raw_label",
                    F.when(F.col("raw_label") == -1, 0).otherwise(F.col("raw_label")).alias("label"))


@register("P23_series_slice", sql=with_ctes(fx.BARS_SQL, body="""SELECT ticker, date, close FROM bars
WHERE ticker = 'Brand#7' AND date BETWEEN DATE '1997-01-01' - 100 AND DATE '1997-01-01' + 30"""), dbl=("close",))
def p23_series_slice(spark, sf_dir):
    """One ticker, dates from 100 days before to 30 days after an event date."""
    b = fx.bars(spark, sf_dir)
    ev = F.lit("1997-01-01").cast("date")
    return b.where((F.col("ticker") == "Brand#7") & F.col("date").between(F.date_sub(ev, 100), F.date_add(ev, 30))).select("ticker", "date", "close")


@register("P24_turnover_gain_bins", sql=with_ctes(*LABEL_CTES, body="""SELECT t.ticker, t.date, t.close * b.volume AS turnover,
  CASE WHEN r > 0 AND r <= 0.8 THEN 0 WHEN r > 0.8 AND r <= 1.2 THEN 1 WHEN r > 1.2 AND r <= 10000 THEN 2 END AS gain_bin
FROM (SELECT ticker, date, close, relative_future_close AS r FROM tr) t JOIN bars b ON t.ticker = b.ticker AND t.date = b.date"""), dbl=("turnover",))
def p24_turnover_gain_bins(spark, sf_dir):
    """Turnover (close x volume) and the gain binned at 0.8 / 1.2 (right-closed bins)."""
    return B.turnover_gain_bins(labelled_history(spark, sf_dir)[0])


# ---------------------------------------------------------------- O1 / O7 / O8 / O9
@register("O1_order_by_ticker_date", sql=with_ctes(fx.BARS_SQL, body="SELECT ticker, date, close FROM bars ORDER BY ticker, date"), dbl=("close",))
def o1_order_by_ticker_date(spark, sf_dir):
    """Rows ordered by (ticker, date) at the sink."""
    return fx.bars(spark, sf_dir).select("ticker", "date", "close").orderBy("ticker", "date")


@register("O7_high_confidence_examples", sql=with_ctes(fx.SCORES_SQL, body="""SELECT l_orderkey, l_linenumber, p FROM scores
WHERE p > 0.7 AND y = 1 ORDER BY l_orderkey, l_linenumber LIMIT 5"""), dbl=("p",))
def o7_high_confidence_examples(spark, sf_dir):
    """First 5 examples with class-1 probability > 0.7 and truth 1 (a top-k report)."""
    s = fx.scores(spark, sf_dir)
    return s.where((F.col("p") > 0.7) & (F.col("y") == 1)).orderBy("l_orderkey", "l_linenumber").limit(5).select("l_orderkey", "l_linenumber", "p")


@register("O8_seeded_shuffle", sql=with_ctes(fx.SCORES_SQL, body="SELECT *, md5('42|' || l_orderkey || '|' || l_linenumber) AS k FROM scores ORDER BY k"), dbl=("p",))
def o8_seeded_shuffle(spark, sf_dir):
    """Rows in a seeded pseudo-random order (MD5 of seed and key)."""
    k = F.md5(F.concat_ws("|", F.lit("42"), "l_orderkey", "l_linenumber"))
    return fx.scores(spark, sf_dir).withColumn("k", k).orderBy("k")


@register("O9_distinct_tickers", sql=with_ctes(fx.BARS_SQL, body="SELECT DISTINCT ticker FROM bars ORDER BY ticker"))
def o9_distinct_tickers(spark, sf_dir):
    """Sorted distinct tickers."""
    return fx.bars(spark, sf_dir).select("ticker").distinct().orderBy("ticker")


# ---------------------------------------------------------------- X7
@register("X7_prepare_and_train")
def x7_prepare_and_train(spark, sf_dir):
    """Annotate -> features -> persist -> train -> metrics (logistic regression)."""
    feats = x1_build_features(spark, sf_dir)
    path = scratch(spark, "prepared")
    RD.write_by_period(feats, path)
    back = RD.read_periods(spark, path, schema=feats.schema)
    _, _, metrics = MD.train(back, X.MODEL_FEATURES, ModelConfig(estimator="logistic_regression"))
    return metrics


_ = (B, feature_matrix_sql)
