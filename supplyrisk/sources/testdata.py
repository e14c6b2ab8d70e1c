"""Binding of the driver's TPC-H-like test tables to the supply-risk model.

The test tables carry no procurement feed, so this module maps them onto
the domain (a test binding, not an operator):

* facility  = customer nation (``c_nationkey``); name ``n_name``, region
  ``r_name``, beds ``140 + 20*nation``
* product   = ``p_type``; category ``p_brand``; critical when the type is
  ECONOMY, SMALL or PROMO (per part: ``p_size >= 25``)
* supplier  = ``l_suppkey``; reliability ``0.75 + 0.05*(key % 5)``, planned
  lead ``1 + key % 7`` days
* one purchase-order line per ``lineitem`` row; the order header is
  ``orders`` (``order_id = ORD-%06d`` of ``o_orderkey``)
* outcome: returned lines (``R``) failed, lines with status ``F`` arrived
  partially (60%), all others arrived in full, every fifth of them 1-3
  days late

``lines`` reads ``lineitem`` alone; ``with_dates``, ``with_facility`` and
``with_product`` add the attributes that a query asks for, one join each.
The joins to order, customer and part are inner for the panel
(``purchase_orders``): a line without a facility or product belongs to no
series.  Such lines are counted by the referential-integrity rules, and the
business rules run on ``lines``, before any join.

Everything is lazy; Catalyst prunes the columns a query does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyrisk.plans.materialize import materialize
from supplyrisk.functions.scalar import int_floor, line_cost, padded_id, week_start

FLOW_VALUES = ("received", "consumption", "n_orders", "sum_reliability", "sum_delay", "n_fulfilled")

# Fixed values of the binding.
CRITICAL_TYPES = ["ECONOMY", "SMALL", "PROMO"]
PARTIAL_FRACTION = 0.6
SIZE_TYPES = ["SMALL", "MEDIUM", "LARGE"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_reliability(supp) -> "F.Column":
    return F.lit(0.75) + F.lit(0.05) * (supp % 5)


def receipt_outcome(qty, fulfilled, partial, order_key, line_number,
                    partial_fraction: float = PARTIAL_FRACTION):
    """Delivered / partial / failed rules -> (quantity_received, delay_days).

    Full delivery: everything, on time or, for every fifth line, 1-3 days
    late.  Partial: ``floor(q*fraction)``, a 2-7 day delay.  Failed:
    nothing, a 5-20 day delay.  The delays are deterministic functions of
    the line key.
    """
    received = (F.when(fulfilled, qty)
                .when(partial, int_floor(qty * F.lit(partial_fraction)))
                .otherwise(F.lit(0).cast("bigint")))
    late = (order_key + line_number) % 5 == 0
    delay = (F.when(fulfilled & late, F.lit(1) + order_key % 3)
             .when(fulfilled, F.lit(0).cast("bigint"))
             .when(partial, F.lit(2) + order_key % 6)
             .otherwise(F.lit(5) + (order_key + line_number) % 16))
    return received, delay


def product_key(grain: str = "type") -> "F.Column":
    """Product of the panel: ``p_type`` (6 products), or brand x type
    (``"brand_type"``, hundreds to thousands of series)."""
    if grain == "type":
        return F.col("p_type")
    if grain == "brand_type":
        return F.concat_ws("|", F.col("p_brand"), F.col("p_type"))
    raise ValueError(f"unknown product grain {grain!r}")


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``lineitem`` that an order line is made of, narrow enough to be joined."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        int_floor(F.col("l_quantity")).alias("quantity_ordered"),
        (F.col("l_returnflag") != F.lit("R")).alias("fulfilled"),
        F.col("l_linestatus").alias("line_status"),
    )


def _with_outcome(facts: DataFrame) -> DataFrame:
    """Add what follows from a line's own columns."""
    received, delay = receipt_outcome(F.col("quantity_ordered"), F.col("fulfilled"), F.col("line_status") == F.lit("F"),
                                      F.col("order_key"), F.col("line_number"))
    return facts.withColumns({
        "order_id": padded_id("ORD-", F.col("order_key")),
        "supplier_reliability": supplier_reliability(F.col("supplier_id")),
        "lead_days_planned": F.lit(1) + F.col("supplier_id") % 7,
        "quantity_received": received,
        "delay_days": delay,
    })


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase-order lines with their outcome, from ``lineitem`` alone."""
    return _with_outcome(_line_facts(spark, sf_dir)).select(
        "order_key", "order_id", "line_number", "part_id", "supplier_id", "supplier_reliability", "lead_days_planned",
        "ship_date", "quantity_ordered", "quantity_received", "delay_days", "fulfilled", "line_status")


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_key, customer_key, order_date) from ``orders``."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"),
        F.col("o_orderdate").cast("date").alias("order_date"))


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers that have a line (a semi-join, no line attribute is shuffled)."""
    keys = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"))
    return order_headers(spark, sf_dir).join(keys, "order_key", "left_semi")


def _delivery(df: DataFrame) -> DataFrame:
    expected = F.date_add("order_date", F.col("lead_days_planned").cast("int"))
    return df.withColumns({"expected_delivery": expected,
                           "actual_delivery": F.date_add(expected, F.col("delay_days").cast("int"))})


def with_dates(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the order's date and the delivery dates."""
    return _delivery(df.join(order_headers(spark, sf_dir).select("order_key", "order_date"), "order_key"))


def facility_of_order(spark: SparkSession, sf_dir: str, headers: DataFrame | None = None) -> DataFrame:
    """Order headers with their facility.  The customer-key shuffle moves headers, not lines."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_key"),
                                               F.col("c_nationkey").alias("facility_id"))
    headers = order_headers(spark, sf_dir) if headers is None else headers
    return headers.join(c, "customer_key").drop("customer_key")


def with_facility(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the order's facility and dates (both come with the order header)."""
    return _delivery(df.join(facility_of_order(spark, sf_dir), "order_key"))


def with_product(df: DataFrame, spark: SparkSession, sf_dir: str, grain: str = "type") -> DataFrame:
    """Add the line's product attributes and its cost."""
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), product_key(grain).alias("product_id"),
        F.col("p_brand").alias("category"), F.col("p_type").isin(CRITICAL_TYPES).alias("critical_item"),
        (F.col("p_size") >= 25).alias("critical_part"), F.col("p_retailprice").alias("unit_cost"))
    return df.join(p, "part_id").withColumn("unit_cost_total", line_cost(F.col("quantity_ordered"), F.col("unit_cost")))


PO_COLUMNS = [
    "order_key", "order_id", "line_number", "facility_id", "product_id", "part_id", "category", "critical_item",
    "critical_part", "supplier_id", "supplier_reliability", "lead_days_planned", "order_date", "expected_delivery",
    "actual_delivery", "ship_date", "quantity_ordered", "quantity_received", "delay_days", "fulfilled",
    "line_status", "unit_cost", "unit_cost_total"]


def purchase_orders(spark: SparkSession, sf_dir: str, grain: str = "type") -> DataFrame:
    """``po``: one row per purchase-order line with all attributes.

    The joins move the columns of the tables; what follows from them is added behind the joins.
    """
    placed = _line_facts(spark, sf_dir).join(facility_of_order(spark, sf_dir), "order_key")
    return _delivery(_with_outcome(with_product(placed, spark, sf_dir, grain))).select(*PO_COLUMNS)


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line feed with the defects of a raw export, for the business rules: zero and missing
    quantities, receipts above the order or below zero, negative delays."""
    k = F.col("order_key") * 7 + F.col("line_number")
    ordered = (F.when(k % 97 == 0, F.lit(0)).when(k % 101 == 0, F.lit(None)).otherwise(F.col("quantity_ordered")))
    received = (F.when(k % 83 == 0, F.col("quantity_ordered") + 1).when(k % 89 == 0, F.lit(-1))
                .otherwise(F.col("quantity_received")))
    return lines(spark, sf_dir).withColumns({
        "quantity_ordered": ordered.cast("bigint"), "quantity_received": received.cast("bigint"),
        "delay_days": F.when(k % 79 == 0, F.lit(-1)).otherwise(F.col("delay_days")).cast("bigint")})


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery records: a failed line has no delivery date and no quantity."""
    done = F.col("quantity_received") > 0
    return with_dates(lines(spark, sf_dir), spark, sf_dir).select(
        "order_id", "line_number", "supplier_id", "expected_delivery",
        F.when(done, F.col("actual_delivery")).alias("actual_delivery"),
        F.when(done, F.col("quantity_received")).alias("quantity_received"), "delay_days", "fulfilled")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_nationkey").alias("facility_id"),
                     F.col("n_name").alias("facility_name"),
                     F.col("r_name").alias("region"),
                     (F.lit(140) + F.lit(20) * F.col("n_nationkey")).cast("bigint").alias("facility_beds")))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("supplier_id"),  # noqa: E127
                    F.col("s_name").alias("supplier_name"),
                    supplier_reliability(F.col("s_suppkey")).alias("reliability"),
                    (F.lit(1) + F.col("s_suppkey") % 7).cast("double").alias("avg_lead_days"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dimension at panel grain (one row per ``p_type``)."""
    p = read(spark, sf_dir, "part")
    return (p.groupBy(F.col("p_type").alias("product_id"))
             .agg(F.avg("p_retailprice").alias("unit_cost"))
             .select("product_id",
                     F.initcap(F.col("product_id")).alias("product_name"),
                     F.when(F.col("product_id").isin(SIZE_TYPES), F.lit("SIZE"))
                      .otherwise(F.lit("TIER")).alias("category"),
                     F.col("product_id").isin(CRITICAL_TYPES).alias("critical_item"),
                     "unit_cost"))


FLOW_TYPES = {"received": "bigint", "consumption": "bigint", "n_orders": "bigint", "sum_reliability": "double",
              "sum_delay": "bigint", "n_fulfilled": "bigint"}


def flow_events() -> list[tuple["F.Column", dict]]:
    """(day, values) of a line's two stock movements: receipt on its order day, consumption on its ship day.

    Consumption of a line is ``floor(q*(78+facility)/100)`` so the drift
    differs per facility.
    """
    consumed = int_floor(F.col("quantity_ordered") * (F.lit(78) + F.col("facility_id")) / F.lit(100.0))
    return [(F.col("order_date"), {"received": F.col("quantity_received"), "n_orders": F.lit(1),
                                   "sum_reliability": F.col("supplier_reliability"), "sum_delay": F.col("delay_days"),
                                   "n_fulfilled": F.col("fulfilled").cast("bigint")}),
            (F.col("ship_date"), {"consumption": consumed})]


def opening_weeks(facility) -> "F.Column":
    """Starting stock in weeks of mean consumption, 2-6 by facility."""
    return F.lit(2) + facility % 5


def daily_table(spark: SparkSession, sf_dir: str, keys=("facility_id", "product_id"), grain: str = "type",
                lookback: bool = False) -> DataFrame:
    """Daily sums per (facility, product), written once: the calendar bounds, the entity list, the panel
    and, with ``lookback``, the 28-day look-back all read them.  The one pass over the order lines."""
    from supplyrisk.operators import features
    events, types = flow_events(), FLOW_TYPES
    if lookback:
        events, types = events + features.lookback_events(), {**FLOW_TYPES, **features.LOOKBACK_VALUES}
    return materialize(features.daily_sums(purchase_orders(spark, sf_dir, grain), events, types, keys), name="daily")


def weekly(daily: DataFrame, keys=("facility_id", "product_id")) -> DataFrame:
    from supplyrisk.operators import panel as P
    return P.weekly_flows(daily.withColumn("week", week_start("day")), list(keys), values=FLOW_VALUES)


def flow_table(spark: SparkSession, sf_dir: str, keys=("facility_id", "product_id"), grain: str = "type",
               daily: DataFrame | None = None) -> DataFrame:
    """Weekly flows per (facility, product), written once for the branches of the calendar."""
    daily = daily_table(spark, sf_dir, keys, grain) if daily is None else daily
    return materialize(weekly(daily, keys), name="flows")


def dense_flows(spark: SparkSession, sf_dir: str, keys=("facility_id", "product_id"),
                grain: str = "type", daily: DataFrame | None = None) -> DataFrame:
    """Zero-filled weekly receipts and consumption per (facility, product).

    Bounds and entities come from the daily table, which is written, so the weekly sums are read once and
    need no table of their own.
    """
    from supplyrisk.operators import panel as P
    daily = daily_table(spark, sf_dir, keys, grain) if daily is None else daily
    ordered = daily.where(F.col("n_orders") > 0)
    bounds = tuple(ordered.select(week_start(f("day"))).scalar() for f in (F.min, F.max))
    return P.dense_calendar(weekly(daily, keys), list(keys), values=FLOW_VALUES, bounds=bounds,
                            entities=daily.select(*keys).distinct())


def inventory_panel(spark: SparkSession, sf_dir: str, keys=("facility_id", "product_id"),
                    passthrough=(), grain: str = "type", daily: DataFrame | None = None) -> DataFrame:
    """Weekly inventory panel of the binding, rolled forward from flows."""
    from supplyrisk.operators import panel as P

    dense = dense_flows(spark, sf_dir, keys, grain, daily)
    return P.inventory_from_flows(
        dense, list(keys),
        opening_weeks=opening_weeks(F.col("facility_id")),
        safety_weeks=2,
        critical=F.element_at(F.split("product_id", "[|]"), -1).isin(CRITICAL_TYPES),
        passthrough=passthrough,
    )


#: Weeks per time block of the long-series form, small enough that every test series has several blocks.
BLOCK_ROWS = 52


def inventory_blocks(spark: SparkSession, sf_dir: str, keys=("facility_id", "product_id"), grain: str = "type") -> DataFrame:
    """``inventory_panel`` with no task holding a whole series (``operators.blocks``), with ``series_index``."""
    from supplyrisk.operators import blocks as B

    flows = flow_table(spark, sf_dir, keys, grain)
    dense = B.dense_calendar(flows, list(keys), BLOCK_ROWS, values=FLOW_VALUES)
    return B.inventory(dense, list(keys), opening_weeks=opening_weeks(F.col("facility_id")), safety_weeks=2,
                       critical=F.element_at(F.split("product_id", "[|]"), -1).isin(CRITICAL_TYPES),
                       rows_per_block=BLOCK_ROWS, blocks_per_group=4)


def ml_dataset(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Inventory panel + rolling features + supplier stats + beds + label."""
    from supplyrisk.operators import dataset

    inv = inventory_panel(spark, sf_dir, passthrough=("n_orders", "sum_reliability", "sum_delay", "n_fulfilled"), daily=daily)
    return dataset.build(inv, facilities(spark, sf_dir))


def ml_dataset_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model table with the 19 documented features (``dataset.EXTENDED_FEATURES``)."""
    from supplyrisk.operators import dataset

    daily = daily_table(spark, sf_dir, lookback=True)
    return dataset.build_extended(inventory_panel(spark, sf_dir, daily=daily), daily)


def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML dataset with the binding's deterministic score and its band."""
    from supplyrisk.operators import risk

    return risk.with_level(ml_dataset(spark, sf_dir).withColumn("risk_score", risk.formula_score()))


# Temporal splits of the binding (the panel runs 1995-2001).
VALIDATION_FROM = "1999-01-01"
TEST_CUTOFF = "2000-01-01"


def supplier_medians(daily: DataFrame) -> dict:
    """Medians of the supplier statistics over the weeks with an order, as scalar Columns.

    They are the ratios of weekly sums, so the weekly sums are enough: no window of the panel runs for them.
    """
    from supplyrisk.functions.stats import exact_quantiles
    from supplyrisk.operators import dataset, risk

    weeks = dataset.supplier_ratios(weekly(daily).where(F.col("n_orders") > 0))
    return exact_quantiles(weeks, risk.IMPUTE_COLUMNS, 0.5)


def imputed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model table with the supplier statistics imputed by their medians."""
    daily = daily_table(spark, sf_dir)
    return ml_dataset(spark, sf_dir, daily).withColumns({c: F.coalesce(F.col(c), m) for c, m in supplier_medians(daily).items()})


def current_scored(spark: SparkSession, sf_dir: str, impute: bool = True) -> DataFrame:
    """Current state per (facility, product) with score and band, written once.

    As the dashboard does: impute the supplier statistics with their
    medians, take the last non-NULL value per column, score it, band it.
    What is written is the latest row per series.
    """
    from supplyrisk.operators import risk

    ds = imputed_dataset(spark, sf_dir) if impute else ml_dataset(spark, sf_dir)
    cur = risk.current_state(ds).withColumn("critical_item", F.col("critical_item").cast("int"))
    return materialize(risk.with_level(cur.withColumn("risk_score", risk.formula_score())), name="current")


def fold_of_series():
    """Deterministic 5-fold assignment by series."""
    return (F.col("facility_id") * F.lit(6) + F.length("product_id")) % F.lit(5)
