"""Dense entity x week panel and the stock roll-forward.

Plan shape (per panel): one aggregate over the flow events (map-side
partial sums, shuffle on entity+week, output is panel-sized), the
calendar bounds as merged scalar subqueries, then a single hash
exchange on the entity keys that the final sum and every window of the
panel reuse.  Every series has the same number of weeks, so the window
partitions are even whatever the skew of the raw lines.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOW_COLS = ("received", "consumption", "n_orders")


def weekly_flows(events: DataFrame, keys: Sequence[str], week: str = "week",
                 values: Sequence[str] = FLOW_COLS) -> DataFrame:
    """Sum flow events per (entity, week): the grouped aggregate behind the
    reference's per-cell mask-and-sum."""
    return (events.groupBy(*keys, week)
                  .agg(*[F.sum(v).alias(v) for v in values]))


def calendar_bounds(flows: DataFrame, week: str = "week", active: str = "n_orders"):
    """First and last week with an order, as scalar-subquery Columns."""
    act = flows.where(F.col(active) > 0)
    return (act.select(F.min(week)).scalar(), act.select(F.max(week)).scalar())


def all_weeks(flows: DataFrame, week: str = "week") -> tuple[Column, Column]:
    """First and last week with any flow."""
    return (flows.select(F.min(week)).scalar(), flows.select(F.max(week)).scalar())


def reconciliation(flows: DataFrame, values: Sequence[str] = ("received", "consumption"), week: str = "week",
                   bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Per value: its total, the part inside the calendar and the part outside.  One row per value."""
    start, end = bounds or calendar_bounds(flows, week)
    inside = F.col(week).between(start, end)
    one = flows.agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)],
                    *[F.coalesce(F.sum(F.when(inside, F.col(v))), F.lit(0)).alias(f"_i{i}") for i, v in enumerate(values)])
    rows = ", ".join(f"'{v}', _t{i}, _i{i}, _t{i} - _i{i}" for i, v in enumerate(values))
    return one.select(F.expr(f"stack({len(values)}, {rows}) AS (flow, total, inside, outside)"))


def dense_calendar(flows: DataFrame, keys: Sequence[str], week: str = "week",
                   values: Sequence[str] = FLOW_COLS, step_days: int = 7,
                   num_partitions: int | None = None, bounds: tuple[Column, Column] | None = None,
                   entities: DataFrame | None = None) -> DataFrame:
    """Every entity x every week between the bounds; missing flows are 0.

    The calendar is generated per entity with ``sequence`` (no join with a
    date table), unioned with the sparse flows and summed once.  ``bounds``
    are the first and last week; by default those with an order, so that
    consumption after the last order week stays outside, as a left join onto
    the order calendar would leave it.  ``all_weeks(flows)`` keeps every
    flow, ``reconciliation`` totals what any bounds leave out.  ``entities``
    (distinct keys) and ``bounds`` save reading ``flows`` for them.
    """
    start, end = bounds or calendar_bounds(flows, week)
    keys = list(keys)
    step = F.expr(f"INTERVAL {int(step_days)} DAYS")
    types = dict(flows.dtypes)
    grid = ((flows.select(*keys).distinct() if entities is None else entities)
                 .select(*keys, F.explode(F.sequence(start, end, step)).alias(week),
                         *[F.lit(0).cast(types[v]).alias(v) for v in values]))
    sparse = flows.where(F.col(week).between(start, end)).select(*keys, week, *values)
    both = grid.unionByName(sparse)
    both = (both.repartition(num_partitions, *keys) if num_partitions
            else both.repartition(*keys))
    return (both.groupBy(*keys, week)
                .agg(*[F.sum(v).alias(v) for v in values])
                .withColumnRenamed(week, "snapshot_date"))


def series_window(keys: Sequence[str], order: str = "snapshot_date") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def roll_forward(df: DataFrame, keys: Sequence[str], opening: Column,
                 order: str = "snapshot_date", inflow: str = "received",
                 outflow: str = "consumption") -> DataFrame:
    """``closing_t = max(0, closing_{t-1} + in_t - out_t)``, ``opening_t = closing_{t-1}``.

    Closed form of the floored recurrence: with ``S_t = opening + sum(in-out)``
    up to t, ``closing_t = S_t - min(0, min_{i<=t} S_i)``.  Two running
    windows over one sort; no state, no UDF.  ``opening`` is the stock
    before the first row (a per-series Column).
    """
    w = series_window(keys, order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (df.withColumn("_open0", opening.cast("bigint"))
             .withColumn("_s", F.col("_open0") + F.sum(F.col(inflow) - F.col(outflow)).over(run)))
    out = out.withColumn("closing_stock",
                         (F.col("_s") - F.least(F.lit(0).cast("bigint"), F.min("_s").over(run))).cast("bigint"))
    out = out.withColumn("opening_stock",
                         F.coalesce(F.lag("closing_stock", 1).over(w), F.col("_open0")))
    return out.drop("_s", "_open0")


def inventory_from_flows(dense: DataFrame, keys: Sequence[str], opening_weeks: Column,
                         safety_weeks: float, critical: Column, passthrough: Sequence[str] = ()) -> DataFrame:
    """Inventory snapshots: opening/closing stock, safety stock and flags.

    Opening stock and safety stock are whole weeks of the series' mean
    weekly consumption (a window aggregate on the same partitioning).
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    mean_c = F.avg("consumption").over(whole)
    df = (dense.withColumn("_mean_c", mean_c)
               .withColumn("safety_stock", F.floor(F.lit(float(safety_weeks)) * F.col("_mean_c")).cast("bigint")))
    df = roll_forward(df, keys, F.floor(opening_weeks * F.col("_mean_c")))
    return df.select(
        *keys, "snapshot_date", "opening_stock", "received", "consumption",
        "closing_stock", "safety_stock",
        (F.col("closing_stock") == 0).cast("int").alias("stockout"),
        (F.col("closing_stock") < F.col("safety_stock")).cast("int").alias("below_safety"),
        critical.alias("critical_item"),
        *passthrough,
    )


def build(flows: DataFrame, keys: Sequence[str], opening_weeks: Column, safety_weeks: float,
          critical: Column, week: str = "week", values: Sequence[str] = FLOW_COLS,
          passthrough: Sequence[str] = ()) -> DataFrame:
    """Weekly flows -> dense calendar -> inventory snapshots (one call)."""
    dense = dense_calendar(flows, keys, week, values)
    return inventory_from_flows(dense, keys, opening_weeks, safety_weeks, critical, passthrough)
