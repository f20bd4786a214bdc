"""Queries: the stateless news operators and two stateful extras run as
Structured Streaming jobs over a JSON-lines feed derived from the documents
(availableNow trigger, checkpoints in the shared folder)."""
from __future__ import annotations

from pyspark.sql import functions as F

from mktlens.functions.sentiment import FIXTURE_LEXICON
from mktlens.plans.q_entity import AS_OF, DAYS, J3_CTES, X11_BODY, _aliases_for_search
from mktlens.plans.q_models import scratch
from mktlens.plans.registry import register, with_ctes
from mktlens.sources import fixtures as fx
from mktlens.session import cut_lineage
from mktlens.streaming import feed as ST


def _feed_dir(spark, sf_dir) -> str:
    path = scratch(spark, "feed-stream-in")
    fx.feed(spark, sf_dir).withColumnRenamed("doc_id", "item_id").drop("item_id").write.mode("overwrite").json(path)
    return path


def _news_table(spark, sf_dir) -> str:
    """Path of the company news drained from the feed stream."""
    src = ST.feed_stream(spark, _feed_dir(spark, sf_dir))
    # The alias dimension is static: stored once for all micro-batches.
    aliases = cut_lineage(_aliases_for_search(spark, sf_dir))
    news = ST.company_news_batch(aliases, FIXTURE_LEXICON, F.lit(AS_OF).cast("timestamp"), DAYS)
    return ST.run_batches(src, news, scratch(spark, "x11-out"), scratch(spark, "x11-ckpt"))


def _news_stream(spark, sf_dir):
    """The news table as a stream of its own."""
    path = _news_table(spark, sf_dir)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).drop("batch")


@register("X11_company_news_stream", sql=with_ctes(*J3_CTES, body=X11_BODY), dbl=("sentiment_score",))
def x11_company_news_stream(spark, sf_dir):
    """Company news as a streaming job (feed files -> alias match -> sentiment), drained to a table."""
    return spark.read.parquet(_news_table(spark, sf_dir)).drop("batch")


DAILY_SQL = with_ctes(*J3_CTES, body=f"""SELECT date_trunc('day', seen_datetime) AS day, ticker, avg(sentiment_score) AS sentiment_mean,
  count(*) AS news_count, avg(CAST(sentiment_score > 0.05 AS DOUBLE)) AS sentiment_pos_ratio,
  avg(CAST(sentiment_score < -0.05 AS DOUBLE)) AS sentiment_neg_ratio
FROM ({X11_BODY}) GROUP BY 1, 2""")


@register("A1_daily_sentiment_stream", sql=DAILY_SQL, dbl=("sentiment_mean", "sentiment_pos_ratio", "sentiment_neg_ratio"))
def a1_daily_sentiment_stream(spark, sf_dir):
    """Daily per-company sentiment over event-time windows with a watermark of a day (update mode, last row per day)."""
    s = ST.daily_sentiment(_news_stream(spark, sf_dir))
    path = ST.run_batches(s, lambda b: b, scratch(spark, "daily-out"), scratch(spark, "daily-ckpt"), "update")
    return ST.latest(spark.read.parquet(path), ["day", "ticker"])


@register("U1_dedupe_stream", sql=with_ctes(*J3_CTES, body=f"SELECT DISTINCT ticker, title, url FROM ({X11_BODY})"))
def u1_dedupe_stream(spark, sf_dir):
    """Duplicates by (ticker, title, url) dropped within a watermark of a day on the stream."""
    d = ST.dedupe_within_watermark(_news_stream(spark, sf_dir), keys=("ticker", "title", "url"))
    return ST.run_append(d, scratch(spark, "dedupe-out"), scratch(spark, "dedupe-ckpt")).select("ticker", "title", "url")
