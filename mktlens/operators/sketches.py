"""Approximate distinct counts (A18) that are kept and united: one small sketch per
group (a file, a day), stored as binary, from which the count of any union of groups
is read without the rows.

The sketch is HyperLogLog of Spark's own aggregates: fixed size whatever it has seen,
combined map-side, and the union of sketches is the sketch of the union.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers are 2 ** this; the standard error of a count is about 1.04 / sqrt(2 ** this).
LOG_REGISTERS = 12


def error(log_registers: int = LOG_REGISTERS) -> float:
    """The relative standard error of a count."""
    return 1.04 / (1 << log_registers) ** 0.5


def sketches(df: DataFrame, groups: list[str], value: str | Column, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(groups, sketch): what each group's values hash to.  Null values do not count; a
    group of nulls has a sketch of nothing."""
    return df.groupBy(*groups).agg(F.hll_sketch_agg(value, log_registers).alias("sketch"))


def united(kept: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Sketches of coarser ``groups`` (none: of all) from kept ones, in any order and any
    number of steps."""
    union = F.hll_union_agg("sketch").alias("sketch")
    return kept.groupBy(*groups).agg(union) if groups else kept.agg(union)


def counts(kept: DataFrame, out: str = "n_distinct") -> DataFrame:
    """The sketches' counts in their place; 0 where there is none."""
    return kept.withColumn(out, F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))).drop("sketch")
