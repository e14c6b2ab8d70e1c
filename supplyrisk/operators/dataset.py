"""Assemble the model table from the inventory panel.

Order matters for the plan: every per-series window (rolling means, the
label) runs on the panel's (facility, product) partitioning first; the
only join left is the facility lookup, which adaptive execution turns
into a broadcast when the facility table is small.  Supplier statistics
arrive as weekly sums folded into the flow aggregate, so they need no
join here (``features.join_supplier_stats`` is the stand-alone form).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyrisk.functions.stats import dense_index
from supplyrisk.operators import features, labels

# Model features and target of the source pipeline, in order.
FEATURES = [
    "closing_stock", "days_of_supply", "avg_consumption_4w", "avg_received_4w",
    "stockout_rate_4w", "below_safety_rate_4w", "avg_supplier_reliability",
    "avg_delay_days", "fulfillment_rate", "facility_beds", "week_of_year",
    "critical_item",
]
TARGET = "stockout_next_14d"


def supplier_ratios(df: DataFrame) -> DataFrame:
    """Weekly supplier stats from folded sums; NULL in weeks without orders."""
    n = F.nullif(F.col("n_orders"), F.lit(0))
    return (df.withColumns({
        "avg_supplier_reliability": F.col("sum_reliability") / n,
        "avg_delay_days": F.col("sum_delay") / n,
        "fulfillment_rate": F.col("n_fulfilled") / n,
    }).drop("n_orders", "sum_reliability", "sum_delay", "n_fulfilled"))


def build(inventory: DataFrame, facility_dim: DataFrame, horizon_rows: int = 2,
          drop_censored: bool = False) -> DataFrame:
    df = features.rolling_mean(inventory)
    df = features.days_of_supply(df)
    df = labels.next_horizon(df, "stockout", horizon_rows, TARGET, drop_censored=drop_censored)
    if "n_orders" in df.columns:
        df = supplier_ratios(df)
    df = df.withColumn("week_of_year", F.weekofyear("snapshot_date"))
    return features.lookup(df, facility_dim, "facility_id", ["facility_beds"])


# The documented 19-feature set.
EXTENDED_FEATURES = [
    "closing_stock", "days_of_supply", "dos_lag_1w", "dos_lag_2w", "dos_lag_4w", "dos_mean_4w", "dos_std_4w",
    "dos_trend_2w", "stockout_count_4w", "po_count_28d", "units_ordered_28d", "avg_fill_rate_28d", "avg_delay_28d",
    "severe_share_28d", "month", "week_of_year", "q4_flag", "facility_code", "product_code",
]


def encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the position of ``col`` among its sorted distinct values (NULL stays NULL)."""
    return df.join(dense_index(df, col, out), col, "left")


def build_extended(inventory: DataFrame, daily: DataFrame, horizon_rows: int = 2) -> DataFrame:
    """Keys, label and ``EXTENDED_FEATURES``: lags, trend and rolling state of the days of supply, the
    28-day procurement look-back, the calendar and the encoded keys.

    The series windows share the panel's partitioning; the look-back joins
    on the same keys, and the code tables hold one row per key value.
    """
    df = features.days_of_supply(features.rolling_mean(inventory))
    df = features.rolling_stats(features.lags(df))
    df = labels.next_horizon(df, "stockout", horizon_rows, TARGET)
    df = df.join(features.procurement_lookback(inventory, daily=daily), ["facility_id", "product_id", "snapshot_date"], "left")
    df = features.calendar(df, "snapshot_date")
    df = encode(encode(df, "facility_id", "facility_code"), "product_id", "product_code")
    return df.select("facility_id", "product_id", "snapshot_date", *EXTENDED_FEATURES, TARGET)
