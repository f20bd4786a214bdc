"""Null-safe column expressions.  Every semantic trap of the pandas original
that can be solved by an expression lives here, so operators stay declarative
and inside whole-stage codegen.

Rule inside the engine: NULL is "missing", NaN never appears.
"""
from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")

# The characters that Python's str.strip() and str.split() take as
# white space, as a regular-expression class (literal, so that it reads the same
# in every engine).
WS = "[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """x/0 -> NULL instead of an ANSI error or inf."""
    return F.try_divide(col(a), col(b))


def finite(x: str | Column) -> Column:
    """Keep only finite values (inf, -inf, NaN -> NULL)."""
    x = col(x)
    return F.when(F.abs(x) < F.lit(INF), x)


def zero_if_null(x: str | Column) -> Column:
    return F.coalesce(col(x), F.lit(0.0))


def pct_change(x: str | Column, base: Column) -> Column:
    """x / base - 1 with a NULL result for base = 0 (pandas gives inf/NaN)."""
    return safe_div(x, base) - F.lit(1.0)


def forward_return(close: str | Column, ahead: Column) -> Column:
    """ahead/close - 1; a zero base keeps pandas' signed infinity."""
    close = col(close)
    return (
        F.when(close != 0, ahead / close - F.lit(1.0))
        .when(ahead > 0, F.lit(INF))
        .when(ahead < 0, F.lit(-INF))
    )


def direction(ret: str | Column) -> Column:
    """Missing return is not "up"."""
    return F.coalesce(col(ret) > 0, F.lit(False)).cast("int")


def rows_frame(w: Window, width: int) -> Window:
    """Trailing frame of ``width`` rows ending at the current row."""
    return w.rowsBetween(-(width - 1), 0)


def strict(agg: Column, counted: str | Column, w: Window, n: int) -> Column:
    """Pandas rolling(n) without min_periods needs a full window."""
    return F.when(F.count(col(counted)).over(w) == n, agg.over(w))


def clip_lower(x: str | Column, lower: float) -> Column:
    """Clip keeps missing values missing."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lower)))


def strip_ws(x: str | Column) -> Column:
    """Python str.strip() removes every kind of surrounding whitespace."""
    return F.regexp_replace(col(x), f"^{WS}+|{WS}+$", "")


def blank_to_null(x: str | Column) -> Column:
    s = strip_ws(x)
    return F.when(F.length(s) > 0, s)


def round6(x: str | Column) -> Column:
    return F.round(col(x), 6)


def zscore_std(v: str | Column, w: Window, min_periods: int = 2) -> Column:
    """Sample std over a frame, exactly 0 for a constant frame, NULL below
    ``min_periods`` observations (W6)."""
    v = col(v)
    n = F.count(v).over(w)
    return F.when(n >= min_periods, F.when(F.min(v).over(w) == F.max(v).over(w), F.lit(0.0)).otherwise(F.stddev_samp(v).over(w)))
