"""Quantiles of any date range from mergeable sketches kept per day.

``stats.exact_quantiles`` reads every row and stays the default.  Where many
ranges are asked for, a KLL sketch per (day, column) is a few kilobytes and
any set of them merges into the sketch of their union, so a range reads its
days' sketches and no rows.  With probability 0.99 the rank of the value returned
differs from the rank asked for by less than ``rank_error(k)`` of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400


def rank_error(k: int = K) -> float:
    """Single-sided normalized rank error of a KLL sketch (the library's published fit)."""
    return 2.296 / k ** 0.9723


def daily(df: DataFrame, day: str, cols: Sequence[str], k: int = K) -> DataFrame:
    """One row per day: a sketch per column (NULLs skipped), built where the rows are and merged per day."""
    return df.groupBy(F.col(day).alias("day")).agg(
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(c) for c in cols])


def merged(sketches: DataFrame, cols: Sequence[str], by: Sequence[Column | str] = (), k: int = K) -> DataFrame:
    """Sketches of unions of days, one row per ``by``."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(c, k).alias(c) for c in cols])


def quantile(sketch: str | Column, q: float = 0.5) -> Column:
    """The sketch's estimate; NULL for a sketch without values."""
    s = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(count(s) > 0, F.kll_sketch_get_quantile_double(s, F.lit(float(q))))


def count(sketch: str | Column) -> Column:
    """Number of values a sketch has seen, exact."""
    return F.kll_sketch_get_n_double(sketch)
