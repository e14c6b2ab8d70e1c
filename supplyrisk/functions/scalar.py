"""Column-level rules.

Each helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "round_half_up", "seasonal_multiplier", "line_cost", "padded_id",
    "int_floor", "days_of_supply", "risk_level", "RISK_BANDS",
    "delay_severe", "delay_band", "coverage_bucket", "quarter_end_flag", "week_start", "month_start",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int) -> Column:
    """Rounding half away from zero: ``sign(x) * floor(|x|*10^n + 0.5)/10^n``.

    ``round``/``bround`` on doubles disagree between engines at exact ties;
    this form gives the same double everywhere.  Reports of the source
    pipeline round half to even; the two differ at exact ties only.
    """
    scale = float(10 ** digits)
    size = F.floor(F.abs(col_of(c)) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(col_of(c) < 0, -size).otherwise(size)


def seasonal_multiplier(date_col, amplitude: float = 0.25, peak_day: int = 355) -> Column:
    """Demand multiplier ``1 + a*cos(2*pi*(doy - peak)/365)`` (peak near day 355)."""
    doy = F.dayofyear(col_of(date_col))
    return F.lit(1.0) + F.lit(amplitude) * F.cos(
        F.lit(2.0 * math.pi) * (doy - F.lit(peak_day)) / F.lit(365.0))


def line_cost(qty, unit_cost) -> Column:
    """Money for a line, ``round(q * c, 2)``."""
    return F.round(col_of(qty) * col_of(unit_cost), 2)


def padded_id(prefix: str, n, width: int = 6) -> Column:
    """Text id such as ``ORD-000042``."""
    return F.format_string(f"{prefix}%0{width}d", col_of(n))


def int_floor(c, lower: int | None = None) -> Column:
    """``int(x)`` for x >= 0 with an optional lower bound, as bigint.

    ``floor`` first: casting a double to an integer truncates in Spark but
    rounds in other engines.
    """
    v = F.floor(col_of(c)).cast("bigint")
    return v if lower is None else F.greatest(F.lit(lower).cast("bigint"), v)


def days_of_supply(closing, avg_consumption, cap: float = 60.0,
                   per_day: bool = False) -> Column:
    """Closing stock over mean consumption (a zero mean counts as 1), capped.

    The default divides by a *weekly* mean, so the unit is weeks, as in the
    source system; ``per_day=True`` multiplies by 7 before the cap.
    """
    ac = col_of(avg_consumption)
    v = col_of(closing) / F.when(ac == 0, F.lit(1.0)).otherwise(ac)
    if per_day:
        v = v * F.lit(7.0)
    return F.least(F.lit(float(cap)), v)


# Band edges and labels (right-closed intervals).
RISK_BANDS = [(-0.001, 0.25, "Low"), (0.25, 0.55, "Medium"), (0.55, 1.001, "High")]


def risk_level(score, bands=RISK_BANDS) -> Column:
    """Right-closed bins ``(lo, hi]``; a score outside every bin is NULL."""
    s = col_of(score)
    expr = None
    for lo, hi, name in bands:
        cond = (s > F.lit(lo)) & (s <= F.lit(hi))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def delay_severe(delay, severe_days: int = 5) -> Column:
    """1 when the delay is at least ``severe_days`` days, else 0."""
    return (col_of(delay) >= F.lit(severe_days)).cast("int")


def delay_band(delay, severe_days: int = 5) -> Column:
    d = col_of(delay)
    return (F.when(d <= 0, F.lit("on_time"))
            .when(d < severe_days, F.lit("late"))
            .otherwise(F.lit("severe")))


def coverage_bucket(weeks_of_supply, bounds=(1.0, 2.0, 4.0)) -> Column:
    """Stock coverage bucket: ``<b1``, ``b1-b2``, ... ``>=bn`` (weeks)."""
    w = col_of(weeks_of_supply)
    expr = None
    prev = None
    for b in bounds:
        label = f"lt_{b:g}w" if prev is None else f"{prev:g}_{b:g}w"
        expr = F.when(w < b, F.lit(label)) if expr is None else expr.when(w < b, F.lit(label))
        prev = b
    return expr.when(w.isNotNull(), F.lit(f"ge_{bounds[-1]:g}w"))


def quarter_end_flag(date_col) -> Column:
    return (F.quarter(col_of(date_col)) == 4).cast("int")


def week_start(date_col) -> Column:
    """Monday of the ISO week, as a date."""
    return F.date_trunc("week", col_of(date_col)).cast("date")


def month_start(date_col) -> Column:
    return F.date_trunc("month", col_of(date_col)).cast("date")
