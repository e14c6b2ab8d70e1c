"""Series of any length: windows and the stock roll-forward over time blocks.

A window partitioned by the series keys sorts a whole series in one task.
Here a series is cut into blocks of ``rows_per_block`` consecutive rows, and
every window is partitioned by (keys, block), so no task holds more than a
block, one series holding a third of all rows or all of them included.

* Windows that look a fixed number of rows back or ahead (rolling means,
  lags, labels): each block also gets copies of the rows next to it (its
  halo), is computed on its own and drops the copies.
* The roll-forward ``s' = max(0, s + x)`` has no such bound, but every step
  is a map ``s -> max(b, s + a)``, and such maps compose to one of their
  kind: ``(a1, b1) then (a2, b2) = (a1 + a2, max(b2, b1 + a2))``.  A block's
  rows compose to one map, the maps of the blocks before it give a block
  its opening stock, and each row's stock follows from that by arithmetic.
  The maps (one row per block) are composed the same way in groups of
  blocks when ``blocks_per_group`` is set.

A row's place in its series (``index``) comes from the calendar of a dense
panel, or for irregular series from two-level prefix sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyrisk.functions.stats import prefix_sums
from supplyrisk.operators import panel
from supplyrisk.plans.materialize import materialize

INDEX, BLOCK, HALO = "series_index", "series_block", "is_halo"


def calendar_index(df: DataFrame, start: Column, order: str = "snapshot_date", step_days: int = 7) -> DataFrame:
    """Add the 0-based place of a row in its series, for a dense calendar that starts at ``start``."""
    return df.withColumn(INDEX, F.floor(F.datediff(F.col(order), start) / step_days).cast("bigint"))


def counted_index(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add the 0-based place of a row in its series, counted; (keys, order) must be unique."""
    return prefix_sums(df, order, [], rank_col=INDEX, partition_by=list(keys))


def blocked(df: DataFrame, rows_per_block: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows of an indexed frame with their block, and copies for the blocks they are the halo of.

    A block sees ``before`` rows ahead of its first row and ``after`` behind its last one.
    """
    i, n = F.col(INDEX), rows_per_block
    first, last = F.floor((i - F.lit(after)) / n), F.floor((i + F.lit(before)) / n)
    own = F.floor(i / n).cast("bigint")
    out = df.withColumn(BLOCK, F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("bigint"), last.cast("bigint"))))
    return out.withColumn(HALO, F.col(BLOCK) != own)


def windowed(df: DataFrame, keys: Sequence[str], fn: Callable[[DataFrame, list[str]], DataFrame], rows_per_block: int,
             before: int = 0, after: int = 0) -> DataFrame:
    """``fn(rows, keys)`` block by block over an indexed frame, equal to ``fn(df, keys)`` as long as no row
    looks further back than ``before`` rows or ahead than ``after`` rows."""
    out = fn(blocked(df, rows_per_block, before, after), [*keys, BLOCK])
    return out.where(~F.col(HALO)).drop(HALO, BLOCK)


def dense_calendar(flows: DataFrame, keys: Sequence[str], rows_per_block: int, week: str = "week",
                   values: Sequence[str] = panel.FLOW_COLS, step_days: int = 7,
                   bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """``panel.dense_calendar`` with ``series_index`` and ``series_block``: the calendar is generated block by
    block, and rows are partitioned by (keys, block)."""
    keys = list(keys)
    start, end = bounds or panel.calendar_bounds(flows, week)
    index = F.floor(F.datediff(F.col(week), start) / step_days).cast("bigint")
    types = dict(flows.dtypes)
    n = F.lit(rows_per_block).cast("bigint")
    last = F.floor(F.datediff(end, start) / step_days).cast("bigint")
    spans = flows.select(*keys).distinct().withColumn("_last", last) \
        .withColumn(BLOCK, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / n).cast("bigint")))) \
        .select(*keys, BLOCK, (F.col(BLOCK) * n).alias("_from"), F.least(F.col(BLOCK) * n + n - 1, F.col("_last")).alias("_to"),
                *[F.lit(0).cast(types[v]).alias(v) for v in values])
    sparse = flows.where(F.col(week).between(start, end)).withColumn("_from", index) \
        .select(*keys, F.floor(F.col("_from") / n).cast("bigint").alias(BLOCK), "_from", F.col("_from").alias("_to"), *values)
    # one row per (entity, block) is shuffled; the block's weeks are generated behind the shuffle
    both = spans.unionByName(sparse).repartition(*keys, BLOCK) \
                .withColumn(INDEX, F.explode(F.sequence("_from", "_to")))
    return both.groupBy(*keys, BLOCK, INDEX).agg(*[F.sum(v).alias(v) for v in values]) \
               .withColumn("snapshot_date", F.date_add(start, (F.col(INDEX) * step_days).cast("int")))


def _then(a1: Column, b1: Column, a2: Column, b2: Column) -> tuple[Column, Column]:
    """The map of (a1, b1) followed by (a2, b2); a null b stands for minus infinity (``greatest`` skips nulls)."""
    return a1 + a2, F.greatest(b2, b1 + a2)


def maps_before(maps: DataFrame, keys: Sequence[str], order: str, per_group: int | None = None) -> DataFrame:
    """(keys, order, before_a, before_b): the composition of all maps (``a``, ``b``) ahead of each row.

    With ``per_group`` the maps are composed in groups of that many consecutive ``order`` numbers, then over
    the groups, so that no window sees more than a group's rows; without, over the whole series at once.
    """
    keys = list(keys)
    group = f"_group_of_{order}"
    part = [*keys, group]
    x = maps.withColumn(group, F.floor(F.col(order) / F.lit(per_group)).cast("bigint") if per_group else F.lit(0).cast("bigint"))
    w = Window.partitionBy(*part).orderBy(order)
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    # after j maps: a = P_j, b = P_j + max over i <= j of (b_i - P_i)
    x = x.withColumn("_p", F.sum("a").over(upto)).withColumn("_low", F.col("b") - F.col("_p"))
    x = x.withColumns({"before_a": F.coalesce(F.sum("a").over(ahead), F.lit(0).cast("bigint"))})
    x = x.withColumn("before_b", F.col("before_a") + F.max("_low").over(ahead))
    if per_group:
        groups = x.groupBy(*part).agg(F.sum("a").alias("a"), F.max("_low").alias("_low")) \
                  .withColumn("b", F.col("a") + F.col("_low")).drop("_low")
        outer = maps_before(groups, keys, group).select(*part, F.col("before_a").alias("_oa"), F.col("before_b").alias("_ob"))
        a, b = _then(F.col("_oa"), F.col("_ob"), F.col("before_a"), F.col("before_b"))
        x = x.join(outer, part).withColumns({"before_a": a, "before_b": b})
    return x.select(*keys, order, "before_a", "before_b")


def stepped(df: DataFrame, keys: Sequence[str], order: str = "snapshot_date", inflow: str = "received",
            outflow: str = "consumption") -> DataFrame:
    """Add each row's map from its block's opening stock: ``_a``, ``_b`` up to the row and ``_pa``, ``_pb`` ahead of it."""
    w = Window.partitionBy(*keys, BLOCK).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = df.withColumn("_a", F.sum((F.col(inflow) - F.col(outflow)).cast("bigint")).over(upto))
    x = x.withColumn("_b", F.col("_a") - F.min("_a").over(upto))
    return x.withColumns({"_pa": F.coalesce(F.lag("_a").over(w), F.lit(0).cast("bigint")), "_pb": F.lag("_b").over(w)})


def roll_forward(df: DataFrame, keys: Sequence[str], opening: Callable[[Column], Column], rows_per_block: int,
                 order: str = "snapshot_date", inflow: str = "received", outflow: str = "consumption",
                 blocks_per_group: int | None = None, per_series: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``panel.roll_forward`` over blocks: adds ``opening_stock`` and ``closing_stock``.

    ``df`` has ``series_index`` (``calendar_index``, ``counted_index``) or, from ``dense_calendar``, its block
    too.  ``opening(mean_outflow)`` is a series' stock before its first row, ``per_series`` more columns of the
    mean.  Rows are shuffled once, by (keys, block), and written with their maps; the rest reads one row per
    block, and rows meet their block's stock in one join.
    """
    keys = list(keys)
    if BLOCK not in df.columns:
        df = df.withColumn(BLOCK, F.floor(F.col(INDEX) / rows_per_block).cast("bigint"))
    rows = materialize(stepped(df, keys, order, inflow, outflow), name="stepped")
    last = F.max_by(F.struct("_a", "_b"), INDEX)
    sums = materialize(rows.groupBy(*keys, BLOCK).agg(last.alias("m"), F.sum(outflow).alias("out"), F.count(F.lit(1)).alias("n"))
                           .select(*keys, BLOCK, F.col("m._a").alias("a"), F.col("m._b").alias("b"), "out", "n"), name="blocks")
    mean = F.sum("out").cast("double") / F.sum("n")
    series = sums.groupBy(*keys).agg(opening(mean).cast("bigint").alias("_open0"),
                                     *[f(mean).alias(c) for c, f in (per_series or {}).items()])
    starts = maps_before(sums, keys, BLOCK, blocks_per_group).join(series, keys) \
        .withColumn("_s0", F.greatest(F.col("before_b"), F.col("_open0") + F.col("before_a")))
    out = rows.join(starts.select(*keys, BLOCK, "_s0", *(per_series or {})), [*keys, BLOCK])
    return out.withColumns({
        "opening_stock": F.greatest(F.col("_pb"), F.col("_s0") + F.col("_pa")),
        "closing_stock": F.greatest(F.col("_b"), F.col("_s0") + F.col("_a"))}).drop("_a", "_b", "_pa", "_pb", "_s0", BLOCK)


def inventory(dense: DataFrame, keys: Sequence[str], opening_weeks: Column, safety_weeks: float, critical: Column,
              rows_per_block: int, passthrough: Sequence[str] = (), blocks_per_group: int | None = None) -> DataFrame:
    """``panel.inventory_from_flows`` over blocks, with ``series_index`` kept for further windows."""
    keys = list(keys)
    df = roll_forward(dense, keys, lambda m: F.floor(opening_weeks * m), rows_per_block, blocks_per_group=blocks_per_group,
                      per_series={"safety_stock": lambda m: F.floor(F.lit(float(safety_weeks)) * m).cast("bigint")})
    return df.select(
        *keys, "snapshot_date", "opening_stock", "received", "consumption", "closing_stock", "safety_stock",
        (F.col("closing_stock") == 0).cast("int").alias("stockout"),
        (F.col("closing_stock") < F.col("safety_stock")).cast("int").alias("below_safety"),
        critical.alias("critical_item"), INDEX, *passthrough)
