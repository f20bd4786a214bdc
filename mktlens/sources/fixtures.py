"""Views of FIXTURES.md over the driver tables — Spark builders and the exact
same recipes in DuckDB SQL (the oracle side).

Every view is derived from the given tables, so its size grows with them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktlens.functions.sentiment import FIXTURE_LEXICON


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# bars: daily (ticker, date, close, volume) from lineitem x part.  Closes are
# whole cents by integer arithmetic so no rounding tie splits the engines.
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    return j.groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(
        (
            F.floor(
                F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
                / F.sum(F.col("l_quantity").cast("bigint"))
            )
            / F.lit(100.0)
        ).alias("close"),
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("volume"),
    )


BARS_SQL = """bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
         floor(sum(CAST(round(l_extendedprice*100) AS BIGINT)) / sum(CAST(l_quantity AS BIGINT))) / CAST(100 AS DOUBLE) AS close,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


# --------------------------------------------------------------------------
# news: one item per document, 25 tickers, 10 dates 30 days apart.
def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    date = F.date_add(F.lit("1996-01-01").cast("date"), (F.lit(30) * (F.floor(F.col("doc_id") / 25) % 10)).cast("int"))
    return d.select(
        F.col("doc_id"),
        F.concat(F.lit("Brand#"), (F.lit(1) + F.col("doc_id") % 25).cast("string")).alias("ticker"),
        F.timestamp_add("MINUTE", (F.col("doc_id") * 37) % 1440, date.cast("timestamp_ntz")).alias("seen_datetime"),
        date.alias("date"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("full_text"),
        F.concat(F.lit("doc://"), (F.col("doc_id") % 900).cast("string")).alias("url"),
        F.col("lang").alias("language"),
        F.col("source"),
        ((F.col("doc_id") % 41 - 20) / F.lit(20.0)).alias("tone"),
        ((F.col("doc_id") % 5) / F.lit(4.0)).alias("relevance"),
    )


NEWS_SQL = """news AS (
  SELECT doc_id,
         'Brand#' || CAST(1 + doc_id % 25 AS VARCHAR) AS ticker,
         CAST(DATE '1996-01-01' + CAST(30 * (floor(doc_id / 25) % 10) AS INTEGER) AS TIMESTAMP) + to_minutes(CAST((doc_id * 37) % 1440 AS BIGINT)) AS seen_datetime,
         DATE '1996-01-01' + CAST(30 * (floor(doc_id / 25) % 10) AS INTEGER) AS date,
         substr(text, 1, 60) AS title, text AS full_text,
         'doc://' || CAST(doc_id % 900 AS VARCHAR) AS url,
         lang AS language, source,
         (doc_id % 41 - 20) / 20.0 AS tone,
         (doc_id % 5) / 4.0 AS relevance
  FROM documents)"""


def _lex_sql(text: str, terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(instr(lower(coalesce({text}, '')), '{t}') > 0 AS INTEGER)" for t in terms)


def lexicon_score_sql(text: str, lex=FIXTURE_LEXICON) -> str:
    pos = _lex_sql(text, lex.positive)
    neg = _lex_sql(text, lex.negative)
    return (
        f"CASE WHEN ({pos}) + ({neg}) = 0 THEN 0.0 ELSE "
        f"CAST(({pos}) - ({neg}) AS DOUBLE) / CAST(({pos}) + ({neg}) AS DOUBLE) END"
    )


def label_sql(score: str) -> str:
    return f"CASE WHEN {score} > 0.1 THEN 'positive' WHEN {score} < -0.1 THEN 'negative' ELSE 'neutral' END"


# annotated news: lexicon sentiment, no language tagger (detected_language NULL).
ANNOTATED_SQL = f"""annotated AS (
  SELECT *, {label_sql('sentiment_score')} AS sentiment_label, CAST(NULL AS VARCHAR) AS detected_language
  FROM (SELECT *, {lexicon_score_sql('full_text')} AS sentiment_score FROM news))"""


# --------------------------------------------------------------------------
# feed: the JSON-lines feed shape.
def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = news(spark, sf_dir)
    return n.select(
        "doc_id",
        F.date_format("seen_datetime", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        "title",
        F.col("full_text").alias("summary"),
        F.col("url").alias("link"),
        F.col("source").alias("source_name"),
        "language",
    )


FEED_SQL = """feed AS (
  SELECT doc_id, strftime(seen_datetime, '%Y-%m-%d %H:%M:%S') AS published_at, title,
         full_text AS summary, url AS link, source AS source_name, language
  FROM news)"""


# --------------------------------------------------------------------------
# registry: one company per distinct part name.
def registry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw registry rows as the CSV would hold them (strings only)."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_name").agg(F.min("p_brand").alias("exchange")).select(
        F.upper(F.regexp_replace("p_name", " ", "")).alias("symbol"),
        F.col("p_name").alias("company"),
        "exchange",
        F.regexp_replace("p_name", " ", ";").alias("aliases"),
        F.col("p_name").alias("row_key"),
    )


REGISTRY_RAW_SQL = """registry_raw AS (
  SELECT upper(replace(p_name, ' ', '')) AS symbol, p_name AS company, min(p_brand) AS exchange,
         replace(p_name, ' ', ';') AS aliases, p_name AS row_key
  FROM part GROUP BY p_name)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text company queries: part names as is, each word, the name with
    its second character removed, the name with ', ' and '#' noise, the company's
    symbol in lower case, every customer name, and every customer key spelled in
    letters that no symbol has (so the query table grows with the data)."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    whole = names.select(F.col("p_name").alias("query"))
    words = names.select(F.explode(F.split("p_name", " ")).alias("query"))
    typo = names.select(F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")).alias("query"))
    noisy = names.select(F.concat(F.lit("#"), F.regexp_replace("p_name", " ", ", ")).alias("query"))
    symbol = names.select(F.concat(F.lit(" "), F.lower(F.regexp_replace("p_name", " ", ""))).alias("query"))
    customers = table(spark, sf_dir, "customer")
    cust = customers.select(F.col("c_name").alias("query"))
    keys = customers.select(F.translate(F.col("c_custkey").cast("string"), "0123456789", "абвгдежзик").alias("query"))
    return whole.union(words).union(typo).union(noisy).union(symbol).union(cust).union(keys).distinct()


QUERIES_SQL = """queries AS (
  SELECT DISTINCT query FROM (
    SELECT p_name AS query FROM part
    UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part
    UNION ALL SELECT substr(p_name, 1, 1) || substr(p_name, 3) FROM part
    UNION ALL SELECT '#' || replace(p_name, ' ', ', ') FROM part
    UNION ALL SELECT ' ' || lower(replace(p_name, ' ', '')) FROM part
    UNION ALL SELECT c_name FROM customer
    UNION ALL SELECT translate(CAST(c_custkey AS VARCHAR), '0123456789', 'абвгдежзик') FROM customer))"""


# --------------------------------------------------------------------------
# scores: truth in {0,1,2} and a score with many ties.
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"),
        (((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000) / F.lit(1000.0)).alias("p"),
    )


SCORES_SQL = """scores AS (
  SELECT l_orderkey, l_linenumber,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
         ((l_orderkey * 7919 + l_linenumber * 104729) % 1000) / 1000.0 AS p
  FROM lineitem)"""


# --------------------------------------------------------------------------
# hourly bars from events: close = last value by (ts, event_id), volume = count.
def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("date")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


HOURLY_BARS_SQL = """hourly AS (
  SELECT event_type AS ticker, date_trunc('hour', ts) AS date,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""


# --------------------------------------------------------------------------
# series: labelled float arrays from embeddings.
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
