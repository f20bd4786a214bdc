"""Structured Streaming wiring of the stateless news operators (§2.11).

The feed conform (S4), search text (F3), alias match (J3), recency (P9) and
lexicon sentiment (F6/F7) are the functions of the batch plans, run on every
micro-batch (``run_batches``).  Two stateful extras over the resulting news
table: duplicates by (title, url) dropped within a watermark (U1) and daily
sentiment aggregates per company over event-time windows (A1-A4).

Sinks are fault tolerant: a checkpoint location in the shared checkpoint
folder and either the file sink (append) or ``foreachBatch`` into a folder per
micro-batch, which a retry overwrites.  State is bounded by the watermark; no
sink rewrites earlier results.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mktlens.functions.sentiment import Lexicon
from mktlens.functions.text import search_text
from mktlens.operators import entity as E
from mktlens.operators import news as N
from mktlens.session import cut_lineage
from mktlens.sources.readers import read_feed


def feed_stream(spark: SparkSession, path: str) -> DataFrame:
    """S4 as a stream: JSON-lines files arriving in ``path``."""
    return read_feed(spark, path, streaming=True).withColumn("combined_norm", search_text("title", "summary"))


def company_news_batch(aliases: DataFrame, lexicon: Lexicon, as_of: Column | None = None, days: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """X11 for one micro-batch of the feed: optional recency filter (P9), alias
    hits (J3), news columns, lexicon sentiment (X3)."""

    def news(batch: DataFrame) -> DataFrame:
        f = batch.withColumn("item_id", F.monotonically_increasing_id())
        if as_of is not None and days is not None:
            f = N.recent(f, as_of, days, "published_at")
        f = cut_lineage(f)  # the item ids are read twice
        return N.annotate_news(E.local_news(f, E.match_text(f, aliases)), "full_text", lexicon)

    return news


def event_time(news: DataFrame) -> DataFrame:
    """Watermarks need a zoned timestamp; the engine's clocks are zone-less
    wall times read in the session zone."""
    return news.withColumn("_event_time", F.col("seen_datetime").cast("timestamp"))


def dedupe_within_watermark(news: DataFrame, delay: str = "1 day", keys=("title", "url")) -> DataFrame:
    """U1 streaming variant: first (title, url) within the watermark delay."""
    w = event_time(news).withWatermark("_event_time", delay)
    return w.dropDuplicatesWithinWatermark(list(keys)).drop("_event_time")


def daily_sentiment(news: DataFrame, delay: str = "1 day") -> DataFrame:
    """A1-A4 over event-time days per company (watermarked)."""
    w = event_time(news).withWatermark("_event_time", delay)
    g = w.groupBy(F.window("_event_time", "1 day").alias("day"), "ticker").agg(
        F.avg("sentiment_score").alias("sentiment_mean"),
        F.count(F.lit(1)).alias("news_count"),
        F.avg((F.col("sentiment_score") > 0.05).cast("double")).alias("sentiment_pos_ratio"),
        F.avg((F.col("sentiment_score") < -0.05).cast("double")).alias("sentiment_neg_ratio"),
    )
    return g.select(F.col("day.start").cast("timestamp_ntz").alias("day"), "ticker", "sentiment_mean", "news_count", "sentiment_pos_ratio", "sentiment_neg_ratio")


def run_append(df: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Drain all available input into a parquet table (append, exactly once)
    and return it as a batch DataFrame."""
    q = (df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.parquet(out_path)


def run_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, mode: str = "append") -> str:
    """Drain all available input; each micro-batch, transformed as a batch plan, is
    written to a folder of its own (``batch=<number>``), which a retry overwrites.
    Returns the path of the table."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return out_path


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row per key of a table of update-mode micro-batches."""
    cols = [c for c in table.columns if c not in (*keys, "batch")]
    g = table.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_r"))
    return g.select(*keys, "_r.*")
