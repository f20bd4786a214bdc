"""Row windows over long series, cut into row-range chunks.

A ``Window.partitionBy(ticker)`` is one task per ticker: a ticker holding a
third of all rows would be sorted and scanned by a single task.  Fixed-width
row frames only look ``lookback`` rows back and ``lookahead`` rows ahead, so
every series, short or long, goes the same way:

1. rows are counted per (key, calendar bucket) (combined map-side); the running
   sum of these few counts and a row number inside each bucket give every row
   its exact 0-based position in its series;
2. positions are cut into chunks of ``CHUNK_ROWS``; the last ``lookback`` rows of
   a chunk also go to the next one and the first ``lookahead`` rows to the
   previous one (halo, one ``explode``);
3. the window expressions run partitioned by (key, chunk) — bounded tasks — and
   only each row's home copy is kept.

Everything is one lazy plan: no sampled bounds, no intermediate table, no job
while it is built, and nothing depends on the size of the input.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 16_384
BUCKET_DAYS = 128


def _bucket(order: str) -> Column:
    """The calendar bucket; rows without a date come first, in one of their own."""
    return F.coalesce(F.floor(F.unix_date(F.col(order).cast("date")) / BUCKET_DAYS).cast("int"), F.lit(-(1 << 31)))


def positions(df: DataFrame, key: str, order: str) -> DataFrame:
    """0-based position ``_i`` of each row in its ``key`` series by the date or
    timestamp ``order`` (nulls first; rows of one time by a hash of all their columns),
    and the series length ``_n``; rows that carry theirs from an earlier step keep
    them."""
    if {"_i", "_n"} <= set(df.columns):
        return df
    b = df.withColumn("_b", _bucket(order))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        b.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
        .select(key, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(Window.partitionBy(key)).alias("_n"))
    )
    inside = Window.partitionBy(key, "_b").orderBy(order, F.xxhash64(*df.columns))
    return b.join(counts, [key, "_b"]).withColumn("_i", F.col("_off") + F.row_number().over(inside) - 1).drop("_b", "_off")


def with_halo(df: DataFrame, key: str, order: str, lookback: int, lookahead: int) -> DataFrame:
    """Rows with position, chunk and ``_home`` (false for halo copies)."""
    size = max(CHUNK_ROWS, lookback, lookahead)
    p = positions(df, key, order)
    c = F.floor(F.col("_i") / size)
    off = F.col("_i") - c * size
    targets = [c]
    if lookback:
        targets.append(F.when((off >= size - lookback) & ((c + 1) * size < F.col("_n")), c + 1))
    if lookahead:
        targets.append(F.when((off < lookahead) & (c > 0), c - 1))
    chunk = F.explode(F.filter(F.array(*targets), lambda x: x.isNotNull()))
    return p.withColumn("_chunk", chunk).withColumn("_home", F.col("_chunk") == c)


def chunk_window(key: str = "ticker") -> Window:
    return Window.partitionBy(key, "_chunk").orderBy("_i")


def apply_windows(df: DataFrame, build: Callable[[DataFrame, Window], DataFrame], key: str = "ticker", order: str = "date",
                  lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Run ``build(frame, window)`` on chunks with a halo; ``build`` keeps the
    columns that begin with an underscore.  Positions are dropped unless the rows
    came with them."""
    out = build(with_halo(df, key, order, lookback, lookahead), chunk_window(key)).where(F.col("_home"))
    return out.drop("_home", "_chunk", *(set() if "_i" in df.columns else {"_i", "_n"}))


def running(value: str, w: Window) -> tuple[Column, Column]:
    """Sum and count of the values so far inside a chunk, halo copies left out."""
    own = F.when(F.col("_home"), F.col(value))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(own).over(so_far), F.count(own).over(so_far)


def add_earlier_chunks(df: DataFrame, key: str, total: str, count: str) -> DataFrame:
    """Running sums inside chunks (home rows) made running sums of the series: the
    last of each chunk, summed in chunk order.  Always added in this order, so a
    value does not depend on how Spark deals the rows."""
    last = df.groupBy(key, "_chunk").agg(F.max_by(total, "_i").alias("_s"), F.max(count).alias("_c"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select(
        key, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0")
    )
    return df.join(offsets, [key, "_chunk"]).withColumn(total, F.col("_s0") + F.col(total)).withColumn(count, F.col("_c0") + F.col(count)).drop("_s0", "_c0")
