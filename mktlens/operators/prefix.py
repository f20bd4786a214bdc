"""Distributed ordered prefix sums and group medians.

A running total over a *global* order is the one thing a plain
``Window.orderBy`` would do in a single task.  Instead:

1. range-partition the rows on the order key (sampled bounds, so a hot key
   value range is spread over many partitions),
2. total each partition (tiny table: one row per partition),
3. prefix those totals (a window over #partitions rows),
4. add the running total inside each partition.

The partition tag is materialised once (see ``_range_parts``): range bounds
come from sampling and could differ if the range shuffle were recomputed.

Every step is a bounded-size task whatever the skew of the data.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def _range_parts(df: DataFrame, n: int, cols: list[str]) -> DataFrame:
    """Rows tagged with their range partition.  The range bounds are sampled
    per execution, so the tagged frame is written once to the shared
    checkpoint folder: every later use (counts, join back, several plan
    branches) sees the same assignment, and a lost executor does not change
    it."""
    from mktlens.session import cut_lineage

    return cut_lineage(df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id()))


def ordered_prefix_sums(df: DataFrame, order_cols: list[str], value_cols: list[str], n_parts: int | None = None,
                        suffix: str = "_before") -> DataFrame:
    """For each row, the sum of each value column over all rows strictly
    before it in ``order_cols`` order (order_cols must be unique per row)."""
    n = _parts(df, n_parts)
    r = _range_parts(df, n, list(order_cols))
    tot = r.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in value_cols])
    inside = Window.partitionBy("_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    # offs has one row per partition: a proven size bound for the broadcast.
    out = r.join(F.broadcast(offs), "_part")
    for c in value_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_part", *[f"_o_{c}" for c in value_cols])


#: Buckets of one level of ``group_median``.
BUCKETS = 4096


def group_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median of ``value`` per ``keys`` group (NULLs ignored), with
    Spark's ``median`` interpolation, without gathering a group in one task.

    ``percentile`` merges a value -> count map per group in a single reducer,
    so a hot group of continuous values is one unbounded buffer.  Instead the middle
    ranks are closed in on, from distinct (key, value) counts (combined map-side):
    1. counts per bucket of the values' signed logarithm between each key's least and
    greatest, and their running sum (at most BUCKETS + 1 rows per key); 2. the same in
    the one or two buckets that hold the middle, by value, between the least and the
    greatest of the bucket, so that neither a few huge values nor many close ones fill
    one bucket of both levels; 3. a running count of values in what is left.  One
    lazy plan."""
    v = F.col(value)
    vc = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    # order-preserving, and finite for infinite values
    scaled = F.signum(v) * F.least(F.log1p(F.abs(v)), F.lit(1e3))
    vc = vc.withColumn("_x", scaled)
    span = vc.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_c").alias("_n")).withColumn("_off", F.lit(0))
    rows, at = vc, list(keys)
    for level, x in ((1, F.col("_x")), (2, v)):
        rows, spans = _closed_in(rows, span, at, x, f"_b{level}", value)
        span, at = spans, [*at, f"_b{level}"]
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    inside = Window.partitionBy(*at).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(span.select(*at, "_off", "_n"), at).withColumn("_first", F.col("_off") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    mids = ranked.groupBy(*keys).agg(
        F.max(F.when(_holds(F.col("_first"), F.col("_c"), lo), v)).alias("_lo"),
        F.max(F.when(_holds(F.col("_first"), F.col("_c"), hi), v)).alias("_hi"),
        F.first("_n").alias("_n"),
    )
    # percentile at 0.5: position (n-1)/2; odd n -> the middle value, even n ->
    # (higher - pos) * lower + (pos - lower) * higher = 0.5 * lower + 0.5 * higher.
    med = F.when(F.col("_n") % 2 == 1, F.col("_lo")).otherwise(F.lit(0.5) * F.col("_lo") + F.lit(0.5) * F.col("_hi"))
    return mids.select(*keys, med.cast("double").alias(out))


def _holds(first, count, rank):
    return (first <= rank) & (rank < first + count)


def _closed_in(rows: DataFrame, span: DataFrame, at: list[str], x, bucket: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their bucket of ``x`` between the span's ends, the buckets that hold
    a middle rank: their ends by value, rows before them, and the key's rows)."""
    width = F.col("_hi") - F.col("_lo")
    place = F.when((width > 0) & (width < float("inf")), F.floor((x - F.col("_lo")) / width * BUCKETS)).otherwise(F.lit(0)).cast("int")
    placed = rows.join(span, at).select(*at, value, "_c", place.alias(bucket), "_off", "_n")
    before = Window.partitionBy(*at).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy(*at, bucket).agg(
        F.sum("_c").alias("_bc"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first("_off").alias("_off"), F.first("_n").alias("_n")
    ).withColumn("_off", F.col("_off") + F.coalesce(F.sum("_bc").over(before), F.lit(0)))
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    middle = per.where(_holds(F.col("_off"), F.col("_bc"), lo) | _holds(F.col("_off"), F.col("_bc"), hi)).drop("_bc")
    return placed.drop("_off", "_n"), middle
