"""Query registry: each SURVEY §2 id maps to a Spark callable and (when the
operator is SQL-expressible) the equivalent DuckDB SQL over the same tables.

Floating outputs listed in ``dbl`` are rounded half-up to 6 decimals on both
sides with the same arithmetic (and -0.0 folded into 0.0) so the value hashes
compare equal; ``arr`` lists array<double> columns rounded
element-wise.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SparkFn = Callable[[SparkSession, str], DataFrame]


def round6(x):
    """Half-up at 6 decimals by the same IEEE operations DuckDB runs below, so
    an identical double rounds identically in both engines (-0.0 -> 0.0)."""
    return F.when(F.abs(x) < 1e9, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(x)


def round6_sql(c: str) -> str:
    return f"CASE WHEN abs({c}) < 1e9 THEN floor({c} * 1e6 + 0.5) / 1e6 ELSE {c} END"


@dataclass
class Query:
    name: str
    spark: SparkFn
    sql: str | None = None
    dbl: tuple[str, ...] = ()
    arr: tuple[str, ...] = ()
    doc: str = ""
    bench: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.spark(spark, sf_dir)
        if self.dbl or self.arr:
            cols = []
            for c in df.columns:
                if c in self.dbl:
                    cols.append(round6(F.col(c)).alias(c))
                elif c in self.arr:
                    cols.append(F.transform(F.col(c), round6).alias(c))
                else:
                    cols.append(F.col(c))
            df = df.select(*cols)
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not (self.dbl or self.arr):
            return self.sql
        rep = [f"{round6_sql(c)} AS {c}" for c in self.dbl] + [
            f"list_transform({c}, lambda x: {round6_sql('x')}) AS {c}" for c in self.arr
        ]
        return f"SELECT * REPLACE ({', '.join(rep)}) FROM (\n{self.sql}\n) AS q"


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None, dbl=(), arr=(), bench: bool = False):
        def deco(fn: SparkFn) -> SparkFn:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = Query(name, fn, sql, tuple(dbl), tuple(arr), (fn.__doc__ or "").strip(), bench)
            return fn

        return deco


REGISTRY = Registry()
register = REGISTRY.add


def with_ctes(*ctes: str, body: str) -> str:
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
