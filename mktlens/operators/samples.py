"""Strided window samples (W13, W14, X10), interval statistics (F16) and
fixed-shape arrays (F19).

W13 without collecting a whole series: rows are gathered into blocks of ``step``
rows and a window is a short row window over blocks.
"""
from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mktlens.functions.exprs import col
from mktlens.operators.chunked import positions

BLOCKS = 1024  # of a chunk


def window_samples(df: DataFrame, value: str, label: str | None, key: str = "ticker", order: str = "date",
                   length: int = 100, step: int = 10) -> DataFrame:
    """Windows of ``length`` rows every ``step`` rows from the series
    start (W13), each with the key, the date and the label of its last row
    (W14; the reference names that date ``start_date`` although it is the end).

    Rows are gathered into blocks of ``step`` rows, and a window is the blocks
    from its own on: one row window over blocks, whose numbers are positions, in
    halo'd chunks of blocks.  No row is copied length / step times.

    Output: key, window_no, end_date, label, values array<double>(length).
    Series shorter than ``length`` give no window (T28).
    """
    lab = F.col(label) if label else F.lit(None)
    known = [c for c in ("_i", "_n") if c in df.columns]
    p = positions(df.select(key, F.col(order).alias("_at"), F.col(value).cast("double").alias("_v"), lab.alias("_label"), *known), key, "_at")
    many = -(-length // step)
    # a window's last row stands at the same place of its last block, whatever the window
    ends = F.when(F.col("_i") % step == (length - 1) % step, F.struct("_at", "_label"))
    blocks = (
        p.where(F.col("_n") >= length)
        .groupBy(key, F.floor(F.col("_i") / step).alias("_block"))
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_pts"), F.max_by(ends, ends.isNotNull()).alias("_end"))
        .withColumn("_pts", F.transform("_pts", lambda x: x["_v"]))
    )
    size = max(BLOCKS, many)
    chunk = F.floor(F.col("_block") / size)
    back = F.when((F.col("_block") % size < many - 1) & (chunk > 0), chunk - 1)
    dealt = blocks.withColumn("_chunk", F.explode(F.filter(F.array(chunk, back), lambda x: x.isNotNull()))).withColumn("_home", F.col("_chunk") == chunk)
    w = Window.partitionBy(key, "_chunk").orderBy("_block")
    over = w.rowsBetween(0, many - 1)
    whole = dealt.withColumn("_pts", F.flatten(F.collect_list("_pts").over(over))).withColumn("_end", F.lead("_end", many - 1).over(w))
    out = whole.where(F.col("_home") & (F.size("_pts") >= length)).select(
        key, F.col("_block").cast("int").alias("window_no"), F.col("_end._at").alias("end_date"),
        F.col("_end._label").alias("label"), F.slice("_pts", 1, length).alias("values"),
    )
    return out if label else out.drop("label")


def window_labels(df: DataFrame, label: str, key: str = "ticker", order: str = "date", length: int = 100,
                  step: int = 10) -> DataFrame:
    """W14 alone: label/date/key at each window's last row, i.e. positions
    length-1, length-1+step, ... (no array gathering)."""
    p = positions(df.select(key, order, label, *[c for c in ("_i", "_n") if c in df.columns]), key, order)
    keep = (F.col("_i") >= length - 1) & (((F.col("_i") - (length - 1)) % step) == 0)
    return p.where(keep).select(key, ((F.col("_i") - (length - 1)) / step).cast("int").alias("window_no"),
                                F.col(order).alias("end_date"), F.col(label).alias("label"))


# ---------------------------------------------------------------- F16
def draw_intervals(series_length: int, seed: int = 42, n_intervals: int | None = None, min_length: int = 3) -> list[tuple[int, int]]:
    """Random intervals (start, end exclusive), sqrt(L) of them by default,
    drawn driver-side from a seed (a fixed, tiny parameter list)."""
    rng = random.Random(seed)
    n = n_intervals or max(1, int(series_length ** 0.5))
    out = []
    for _ in range(n):
        start = rng.randrange(0, series_length - min_length + 1)
        end = rng.randrange(start + min_length, series_length + 1)
        out.append((start, end))
    return out


def _slope(arr: Column) -> Column:
    """Closed-form least-squares slope of arr against 0..n-1."""
    n = F.size(arr).cast("double")
    idx = F.sequence(F.lit(0), F.size(arr) - 1)
    sx = (n * (n - 1)) / 2.0
    sxx = (n - 1) * n * (2 * n - 1) / 6.0
    sy = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    sxy = F.aggregate(F.arrays_zip(idx.alias("i"), arr.alias("v")), F.lit(0.0), lambda a, z: a + z["i"] * z["v"])
    den = n * sxx - sx * sx
    return F.when(den != 0, (n * sxy - sx * sy) / den).otherwise(F.lit(0.0))


def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)


def _std(arr: Column) -> Column:
    """Population std (numpy default ddof=0), two-pass."""
    m = _mean(arr)
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.sqrt(ss / F.size(arr))


def interval_features(df: DataFrame, values: str, intervals: list[tuple[int, int]]) -> DataFrame:
    """F16: mean, std and slope over each interval, as columns
    i{k}_mean / i{k}_std / i{k}_slope (higher-order functions, no UDF)."""
    cols = []
    for k, (a, b) in enumerate(intervals):
        sl = F.slice(col(values), a + 1, b - a)
        cols += [_mean(sl).alias(f"i{k}_mean"), _std(sl).alias(f"i{k}_std"), _slope(sl).alias(f"i{k}_slope")]
    return df.select("*", *cols)


def to_vector(df: DataFrame, values: str, out: str = "features") -> DataFrame:
    """array<double> -> ML vector."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.col(values)))
