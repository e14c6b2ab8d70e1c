"""Dashboard reports as DataFrames (the reference serves them as JSON).

Reports read the already-small current state or aggregate the large
order table with partial (map-side) aggregation first; dimension names
are joined after the aggregate, so the join sees one row per group.  No
broadcast hints: adaptive execution broadcasts a side only when its
runtime size is under ``spark.sql.autoBroadcastJoinThreshold`` and keeps
a shuffle join otherwise (dimensions such as suppliers grow with data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyrisk.functions.scalar import round_half_up
from supplyrisk.functions.stats import exact_quantiles
from supplyrisk.plans.materialize import materialize


def supplier_delays(po: DataFrame, supplier_dim: DataFrame | None = None,
                    sort: bool = True) -> DataFrame:
    """Per supplier over delayed lines: count, mean / max delay, fulfilled share.

    Sorted by the *unrounded* mean delay, descending (supplier id breaks
    ties); means are then rounded to 2 and 3 places.
    """
    agg = (po.where(F.col("delay_days") > 0)
             .groupBy("supplier_id")
             .agg(F.count("order_id").alias("delayed_orders"),
                  F.avg("delay_days").alias("_avg_delay"),
                  F.max("delay_days").alias("max_delay_days"),
                  F.avg(F.col("fulfilled").cast("int")).alias("_fill")))
    if supplier_dim is not None:
        agg = agg.join(supplier_dim.select("supplier_id", "supplier_name"), "supplier_id", "left")
    else:
        agg = agg.withColumn("supplier_name", F.lit(None).cast("string"))
    if sort:
        agg = agg.orderBy(F.col("_avg_delay").desc(), F.col("supplier_id").asc())
    return agg.select("supplier_id", "delayed_orders",
                      round_half_up("_avg_delay", 2).alias("avg_delay_days"),
                      "max_delay_days",
                      round_half_up("_fill", 3).alias("fulfillment_rate"),
                      "supplier_name")


def facility_summary(current: DataFrame, facility_dim: DataFrame | None = None,
                     high: str = "High", medium: str = "Medium",
                     critical_above: float | None = None, digits: int | None = None,
                     sort: bool = True) -> DataFrame:
    """Per facility: High / Medium counts, mean risk, stockouts among critical items.

    ``critical_above`` adds a ``critical_risk_items`` count (score above the
    bound), the README's extra band.  ``digits`` rounds the mean half-up.
    """
    crit = F.col("critical_item").cast("int") == 1
    aggs = [F.count_if(F.col("risk_level") == high).alias("high_risk_items"),
            F.count_if(F.col("risk_level") == medium).alias("medium_risk_items"),
            F.avg("risk_score").alias("_mean"),
            F.sum(F.when(crit, F.col("stockout")).otherwise(F.lit(0))).cast("bigint").alias("critical_stockouts")]
    if critical_above is not None:
        aggs.append(F.count_if(F.col("risk_score") > F.lit(critical_above)).alias("critical_risk_items"))
    out = current.groupBy("facility_id").agg(*aggs)
    if facility_dim is not None:
        out = out.join(facility_dim.select("facility_id", "facility_name", "facility_beds"), "facility_id", "left")
    if sort:
        out = out.orderBy(F.col("_mean").desc(), F.col("facility_id"))
    mean = round_half_up("_mean", digits) if digits is not None else F.col("_mean")
    cols = ["facility_id", "high_risk_items", "medium_risk_items", mean.alias("mean_risk_score"),
            "critical_stockouts"]
    if critical_above is not None:
        cols.append("critical_risk_items")
    if facility_dim is not None:
        cols += ["facility_name", "facility_beds"]
    return out.select(*cols)


def risk_query(current: DataFrame, facility_id=None, risk_level: str | None = None,
               critical_only: str | bool | None = None, limit: int = 100) -> DataFrame:
    """Filtered risk table, highest score first, top ``limit`` rows.

    Filters apply only when given; an unknown value gives an empty result.
    ``critical_only`` follows the query-string rule: only ``"true"`` (or
    True) filters.  Ties on the score are broken by the keys so the cut at
    ``limit`` is deterministic.
    """
    df = current
    if facility_id is not None and facility_id != "":
        df = df.where(F.col("facility_id") == F.lit(facility_id))
    if risk_level:
        df = df.where(F.col("risk_level") == F.lit(risk_level))
    if critical_only is True or critical_only == "true":
        df = df.where(F.col("critical_item").cast("int") == 1)
    df = df.orderBy(F.col("risk_score").desc(), "facility_id", "product_id").limit(limit)
    return df.select("facility_id", "product_id", "closing_stock",
                     round_half_up("days_of_supply", 1).alias("days_of_supply"),
                     round_half_up("risk_score", 4).alias("risk_score"),
                     F.col("risk_level").cast("string").alias("risk_level"),
                     F.col("critical_item").cast("int").alias("critical_item"),
                     "stockout_rate_4w", "avg_delay_days")


def alerts(current: DataFrame, facility_dim: DataFrame, product_dim: DataFrame,
           level: str = "High", limit: int = 50) -> DataFrame:
    """High-risk critical items with names; ``total_alerts`` is counted before the limit.

    The total is a distributed count (scalar subquery), not a window over
    all alert rows.
    """
    sel = current.where((F.col("risk_level") == level) & (F.col("critical_item").cast("int") == 1))
    total = sel.select(F.count(F.lit(1))).scalar()
    order = [F.col("risk_score").desc(), F.col("facility_id"), F.col("product_id")]
    # cut to the top rows first, then look up names for those rows only
    top = (sel.orderBy(*order).limit(limit)
              .join(facility_dim.select("facility_id", "facility_name"), "facility_id", "left")
              .join(product_dim.select("product_id", "product_name"), "product_id", "left")
              .orderBy(*order))
    return top.select(total.alias("total_alerts"), "facility_id", "facility_name", "product_id",
                      "product_name", round_half_up("risk_score", 4).alias("risk_score"),
                      "closing_stock", round_half_up("days_of_supply", 1).alias("days_of_supply"),
                      "avg_delay_days", "stockout_rate_4w")


def stat_strip(current: DataFrame, high: str = "High", critical_above: float = 0.80,
               digits: int | None = 6) -> DataFrame:
    """Network totals: items, critical items, High items, critical-band items, mean risk."""
    out = current.agg(
        F.count(F.lit(1)).alias("items_monitored"),
        F.count_if(F.col("critical_item").cast("int") == 1).alias("critical_items"),
        F.count_if(F.col("risk_level") == high).alias("high_risk_items"),
        F.count_if(F.col("risk_score") > F.lit(critical_above)).alias("critical_risk_items"),
        F.avg("risk_score").alias("_mean"))
    mean = round_half_up("_mean", digits) if digits is not None else F.col("_mean")
    return out.select("items_monitored", "critical_items", "high_risk_items",
                      "critical_risk_items", mean.alias("mean_risk_score"))


def supplier_facility_alerts(po: DataFrame, max_on_time: float = 0.80, severe_days: int = 5,
                             digits: int = 4) -> DataFrame:
    """Supplier x facility pairs whose on-time rate is below ``max_on_time``."""
    agg = (po.groupBy("supplier_id", "facility_id")
             .agg(F.count(F.lit(1)).alias("n_orders"),
                  F.count_if(F.col("delay_days") == 0).alias("on_time_orders"),
                  F.avg("delay_days").alias("_avg_delay"),
                  F.count_if(F.col("delay_days") >= severe_days).alias("severe_delays")))
    agg = agg.withColumn("_rate", F.col("on_time_orders") / F.col("n_orders"))
    return (agg.where(F.col("_rate") < F.lit(max_on_time))
               .select("supplier_id", "facility_id", "n_orders", "on_time_orders",
                       round_half_up("_rate", digits).alias("on_time_rate"),
                       round_half_up("_avg_delay", 2).alias("avg_delay_days"),
                       "severe_delays"))


def risk_search(current: DataFrame, product_dim: DataFrame, category: str | None = None,
                text: str | None = None, risk_level: str | None = None) -> DataFrame:
    """Risk table filtered by category and a case-insensitive name search."""
    df = current.join(product_dim.select("product_id", "product_name", "category"), "product_id", "left")
    if category:
        df = df.where(F.col("category") == F.lit(category))
    if text:
        df = df.where(F.lower(F.col("product_name")).contains(text.lower()))
    if risk_level:
        df = df.where(F.col("risk_level") == F.lit(risk_level))
    return df.select("facility_id", "product_id", "product_name", "category",
                     round_half_up("risk_score", 4).alias("risk_score"), "risk_level")


def category_stockout_rate(inventory: DataFrame, bridge: DataFrame, category_col: str = "category",
                           digits: int = 6) -> DataFrame:
    """Stockout frequency per category, with an above-median flag, highest first.

    ``bridge`` holds the (product, critical, category) rows of the order
    table; a product may have several categories.  Snapshots are summed per
    (product, critical) first, so the bridge multiplies grouped rows only,
    and the rate table (one row per category) is written before its median.
    """
    per = inventory.groupBy("product_id", "critical_item").agg(F.sum("stockout").alias("_s"), F.count("stockout").alias("_n"))
    pairs = bridge.select("product_id", "critical_item", F.col(category_col).alias("category")).distinct()
    rate = materialize(per.join(pairs, ["product_id", "critical_item"], "left")
                          .groupBy("category").agg((F.sum("_s") / F.sum("_n")).alias("_rate")))
    med = exact_quantiles(rate, ["_rate"], 0.5)["_rate"]
    return (rate.orderBy(F.col("_rate").desc(), "category")
                .select("category", round_half_up("_rate", digits).alias("stockout_rate"),
                        (F.col("_rate") > med).cast("int").alias("above_median")))


def facility_risk_summary(scored_test: DataFrame, label: str = "stockout_next_14d",
                          score: str = "risk_score", digits: int | None = 6) -> DataFrame:
    """Test period per facility: actual label rate, mean predicted score, count."""
    out = (scored_test.groupBy("facility_id")
                      .agg(F.avg(label).alias("_actual"), F.avg(score).alias("_pred"),
                           F.count(label).alias("n_samples"))
                      .orderBy(F.col("_actual").desc(), "facility_id"))
    r = (lambda c: round_half_up(c, digits)) if digits is not None else F.col
    return out.select("facility_id", r("_actual").alias("actual_stockout_rate"),
                      r("_pred").alias("predicted_risk_score"), "n_samples")


# ---- user-facing names -------------------------------------------
facilities = facility_summary
risk = risk_query
