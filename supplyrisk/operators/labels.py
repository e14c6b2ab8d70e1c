"""Forward-looking labels.

The label of a row looks at *its own* series' next rows (a ``lead`` over
the per-series window), which is the documented intent of the source
pipeline; its index-aligned assignment put labels on other rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("facility_id", "product_id")


def next_horizon(df: DataFrame, event: str | Column = "stockout", rows: int = 2,
                 out: str = "stockout_next_14d", keys: Sequence[str] = KEYS,
                 order: str = "snapshot_date", drop_censored: bool = False) -> DataFrame:
    """1 when ``event`` happens in any of the next ``rows`` rows, else 0.

    Rows past the end of a series count as no event (the source's
    ``fillna(0)``); ``drop_censored=True`` drops rows whose horizon is
    not fully observed instead.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ev = F.col(event) if isinstance(event, str) else event
    leads = [F.lead(ev, k).over(w) for k in range(1, rows + 1)]
    lab = F.greatest(*[F.coalesce(x, F.lit(0)) for x in leads]) if rows > 1 else F.coalesce(leads[0], F.lit(0))
    res = df.withColumn(out, lab.cast("int"))
    if drop_censored:
        res = res.withColumn("_cens", leads[-1].isNull()).where(~F.col("_cens")).drop("_cens")
    return res


def next_days(df: DataFrame, event: str = "stockout", days: int = 14,
              out: str = "stockout_next_14d", keys: Sequence[str] = KEYS,
              order: str = "snapshot_date") -> DataFrame:
    """Irregular snapshots: max of ``event`` over the next ``days`` days
    (range frame on the day number), missing -> 0."""
    w = (Window.partitionBy(*keys).orderBy(F.unix_date(F.col(order)))
         .rangeBetween(1, days))
    return df.withColumn(out, F.coalesce(F.max(F.col(event)).over(w), F.lit(0)).cast("int"))


def below_reorder_flag(closing: str = "closing_stock", reorder_point: str = "safety_stock",
                       pct: int = 30) -> Column:
    """Stock under ``pct``% of the reorder point, in integers: ``closing*100 < pct*rp``."""
    return (F.col(closing) * F.lit(100) < F.lit(pct) * F.col(reorder_point)).cast("int")


def reorder_horizon(df: DataFrame, rows: int = 2, pct: int = 30,
                    out: str = "stockout_reorder_14d", keys: Sequence[str] = KEYS) -> DataFrame:
    """README rule: stock falls below 30% of the reorder point within the horizon."""
    df = df.withColumn("below_reorder_30", below_reorder_flag(pct=pct))
    return next_horizon(df, "below_reorder_30", rows, out, keys)
