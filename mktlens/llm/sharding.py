"""Reproducible global shuffle into shards by a Feistel permutation."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktlens.llm._arrow import mix

ROUNDS = 6


def _half_bits(n: int) -> int:
    """Bits of each half of the smallest even-bit domain that holds n numbers."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & ((1 << 64) - 1)))


def permute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The position of each row number x (0 <= x < n) in the shuffled order.

    A balanced Feistel network is a bijection of [0, 4**h); walking its cycle
    until the value is below n again makes it a bijection of [0, n)."""
    h = np.uint64(_half_bits(n))
    low = np.uint64((1 << int(h)) - 1)
    keys = _keys(seed)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << h) | right

    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo])
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def unpermute(y: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each position y: the inverse walk."""
    h = np.uint64(_half_bits(n))
    low = np.uint64((1 << int(h)) - 1)
    keys = _keys(seed)[::-1]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & low
        for k in keys:
            left, right = right ^ (mix(left + k) & low), left
        return (left << h) | right

    out = y.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo])
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def shard_of(position, shards: int):
    """Shard and slot of a position: row counts of shards differ by one at most."""
    return position % shards, position // shards


def number_rows(df: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """``row_number`` (from 0, gapless, the same on every run) and ``n_rows`` for
    every row of a table of narrow columns.

    Rows are ordered by (hash group, keys).  Equal rows are counted first
    (combined before the shuffle) and dealt out again at the end, so one key or
    one row repeated without end does not meet in one task; the running sum is
    over one row per group.
    """
    equal = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    equal = equal.withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"))
    per = equal.groupBy("_g").agg(F.sum("_c").alias("_n"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group: a bounded broadcast
    offsets = F.broadcast(
        per.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("n_rows"))
    )
    inside = Window.partitionBy("_g").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    numbered = equal.withColumn("_o2", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(offsets, "_g")
    first = F.col("_o") + F.col("_o2")
    return numbered.select(
        *df.columns, F.explode(F.sequence(first, first + F.col("_c") - 1)).alias("row_number"), "n_rows"
    )


def shard(df: DataFrame, shards: int = 16, seed: int = 0, groups: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into shards 0 to shards - 1 under the law ``rows``: counts of
    shards differ by one at most.

    Each row gets a global row number that depends on its id and text alone, the
    Feistel permutation of that number is its position in the shuffled order, and
    shard = position % shards, slot = position // shards.  So both can be computed
    from a row number, and the row number from a shard and slot (``unpermute``).
    The texts are read once for their size and CRC and never shuffled.

    Size: UTF-8 bytes plus 1; null text: size 1 and the CRC of the empty text.
    Equal rows get a place each.  Null ids are ids of their own kind.  Other
    columns are ignored.  An empty table gives an empty result.  Columns: the id,
    size, text_crc32, row_number, law, shard, slot, grown_shard (null: the law
    ``key`` does not hold).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )

    @F.pandas_udf("long")
    def position(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(np.int64), int(n.iloc[0]), seed)) if len(x) else pd.Series([], dtype="int64")

    placed = number_rows(narrow, ["_id", "size", "text_crc32"], groups).withColumn("_p", position("row_number", "n_rows"))
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", "row_number", F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
