"""Panel features: rolling means, days of supply, lags, calendar, supplier
statistics and the 28-day procurement lookback.

All per-series windows use ``Window.partitionBy(keys).orderBy(date)``;
Catalyst puts every window with that spec behind one exchange and one
sort, so a chain of these calls costs a single shuffle of the panel
(none at all when the panel is already partitioned by its keys).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyrisk.functions.scalar import (days_of_supply as _dos, delay_severe,
                                         month_start, quarter_end_flag, week_start)

KEYS = ("facility_id", "product_id")
ROLLING_4W = {
    "consumption": "avg_consumption_4w",
    "received": "avg_received_4w",
    "stockout": "stockout_rate_4w",
    "below_safety": "below_safety_rate_4w",
}


def _w(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def rolling_mean(df: DataFrame, cols: Mapping[str, str] = ROLLING_4W, rows: int = 4,
                 keys: Sequence[str] = KEYS, order: str = "snapshot_date") -> DataFrame:
    """Trailing mean over the last ``rows`` rows (current included), min 1 row."""
    frame = _w(keys, order).rowsBetween(-(rows - 1), Window.currentRow)
    return df.withColumns({out: F.avg(F.col(src)).over(frame) for src, out in cols.items()})


def days_of_supply(df: DataFrame, closing: str = "closing_stock",
                   avg_consumption: str = "avg_consumption_4w", cap: float = 60.0,
                   per_day: bool = False, out: str = "days_of_supply") -> DataFrame:
    return df.withColumn(out, _dos(closing, avg_consumption, cap, per_day))


def lags(df: DataFrame, col: str = "days_of_supply", periods: Sequence[int] = (1, 2, 4),
         trend_periods: int = 2, prefix: str = "dos", keys: Sequence[str] = KEYS,
         order: str = "snapshot_date") -> DataFrame:
    """``lag`` columns at 1, 2 and 4 weeks and the 2-week trend ``c - lag(c, 2)``."""
    w = _w(keys, order)
    cols = {f"{prefix}_lag_{p}w": F.lag(col, p).over(w) for p in periods}
    cols[f"{prefix}_trend_{trend_periods}w"] = F.col(col) - F.lag(col, trend_periods).over(w)
    return df.withColumns(cols)


def rolling_stats(df: DataFrame, col: str = "days_of_supply", count_col: str = "stockout",
                  rows: int = 4, prefix: str = "dos", keys: Sequence[str] = KEYS,
                  order: str = "snapshot_date") -> DataFrame:
    """4-week mean and sample std of ``col``; 4-week sum of ``count_col``."""
    frame = _w(keys, order).rowsBetween(-(rows - 1), Window.currentRow)
    return df.withColumns({
        f"{prefix}_mean_{rows}w": F.avg(col).over(frame),
        f"{prefix}_std_{rows}w": F.stddev_samp(col).over(frame),
        f"{count_col}_count_{rows}w": F.sum(count_col).over(frame).cast("bigint"),
    })


def calendar(df: DataFrame, date_col: str) -> DataFrame:
    """ISO week, month, Q4 flag, week start and month start of ``date_col``."""
    d = F.col(date_col)
    return df.withColumns({
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "q4_flag": quarter_end_flag(d),
        "order_week": week_start(d),
        "order_month": month_start(d),
    })


def supplier_stats(po: DataFrame, keys: Sequence[str] = KEYS, date_col: str = "order_date",
                   weekly: bool = True) -> DataFrame:
    """Mean supplier reliability, delay and fulfilled share per (keys, date).

    ``weekly`` groups by the order week so the result joins a weekly panel.
    Note: the statistics include the eventual delay of orders placed that
    week (look-ahead); ``procurement_lookback`` is the leakage-free form.
    """
    d = week_start(date_col) if weekly else F.col(date_col)
    return (po.groupBy(*keys, d.alias("snapshot_date"))
              .agg(F.avg("supplier_reliability").alias("avg_supplier_reliability"),
                   F.avg("delay_days").alias("avg_delay_days"),
                   F.avg(F.col("fulfilled").cast("int")).alias("fulfillment_rate")))


def join_supplier_stats(panel: DataFrame, stats: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join on (keys, snapshot_date); weeks without orders get NULLs."""
    return panel.join(stats, [*keys, "snapshot_date"], "left")


def lookup(df: DataFrame, dim: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Dimension lookup (missing key -> NULL attributes), a left join."""
    return df.join(dim.select(key, *cols), key, "left")


# Per-day sums behind the look-back: lines and units by order day, outcomes by delivery day.
LOOKBACK_VALUES = {"lb_lines": "bigint", "lb_units": "bigint", "lb_delivered": "bigint", "lb_fill": "double",
                   "lb_delay": "bigint", "lb_severe": "bigint"}


def lookback_events(severe_days: int = 5) -> list[tuple["F.Column", dict]]:
    """(day, values) of the two events of a line: its order and its delivery."""
    fill = F.col("quantity_received") / F.nullif(F.col("quantity_ordered"), F.lit(0))
    return [(F.col("order_date"), {"lb_lines": F.lit(1), "lb_units": F.col("quantity_ordered")}),
            (F.col("actual_delivery"), {"lb_delivered": F.lit(1), "lb_fill": fill, "lb_delay": F.col("delay_days"),
                                        "lb_severe": delay_severe("delay_days", severe_days)})]


def daily_sums(po: DataFrame, events: Sequence[tuple["F.Column", Mapping]], types: Mapping[str, str],
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum the values of dated events per (keys, day): one explode over the lines, summed before the shuffle."""
    structs = F.array(*[F.struct(d.alias("day"), *[v.get(c, F.lit(0)).cast(t).alias(c) for c, t in types.items()])
                        for d, v in events])
    return (po.select(*keys, F.explode(structs).alias("e")).select(*keys, "e.*").where(F.col("day").isNotNull())
              .groupBy(*keys, "day").agg(*[F.sum(c).alias(c) for c in types]))


def procurement_lookback(panel: DataFrame, po: DataFrame | None = None, days: int = 28,
                         keys: Sequence[str] = KEYS, severe_days: int = 5,
                         snapshot: str = "snapshot_date", daily: DataFrame | None = None) -> DataFrame:
    """Procurement velocity over the ``days`` days before each snapshot.

    PO line count and units ordered over the lines *ordered* in
    ``[d - days, d - 1]``; mean fill rate, mean delay and the share of severe
    delays over the lines *delivered* in it.  The outcome of a line counts
    from its delivery day on, so no value uses what a snapshot could not
    know.  Snapshots and daily sums (``daily``, or computed from ``po``) are
    unioned and a range frame on the day number sums them: one shuffle on
    the keys, no range join.
    """
    keys, values = list(keys), LOOKBACK_VALUES
    if daily is None:
        daily = daily_sums(po, lookback_events(severe_days), values, keys)
    daily = daily.select(*keys, F.unix_date("day").alias("_day"), *values, F.lit(False).alias("_is_snap"))
    snaps = panel.select(*keys, F.unix_date(F.col(snapshot)).alias("_day"),
                         *[F.lit(None).cast(t).alias(c) for c, t in values.items()], F.lit(True).alias("_is_snap"))
    frame = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-days, -1)
    zero = F.lit(0).cast("bigint")
    delivered = F.nullif(F.sum("lb_delivered").over(frame), F.lit(0))
    out = (daily.unionByName(snaps)
                .withColumns({
                    f"po_count_{days}d": F.coalesce(F.sum("lb_lines").over(frame), zero),
                    f"units_ordered_{days}d": F.coalesce(F.sum("lb_units").over(frame), zero),
                    f"avg_fill_rate_{days}d": F.sum("lb_fill").over(frame) / delivered,
                    f"avg_delay_{days}d": F.sum("lb_delay").over(frame) / delivered,
                    f"severe_share_{days}d": F.sum("lb_severe").over(frame) / delivered,
                })
                .where("_is_snap")
                .withColumn(snapshot, F.date_from_unix_date("_day")))
    return out.select(*keys, snapshot, f"po_count_{days}d", f"units_ordered_{days}d",
                      f"avg_fill_rate_{days}d", f"avg_delay_{days}d", f"severe_share_{days}d")


# ---- user-facing names -------------------------------------------
rolling = rolling_mean
procurement = procurement_lookback
supplier = supplier_stats
