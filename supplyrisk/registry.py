"""Query keys of the workload over the driver test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; the keys match
read an intermediate on several branches (the panel, the score table, the
star schema, a trained model) write it while they are built; wrap them in
``plans.intermediates`` to delete those tables afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window

from supplyrisk.functions import scalar as S
from supplyrisk.operators import report
from supplyrisk.plans.materialize import materialize
from supplyrisk.session import checkpoint_dir
from supplyrisk.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@query("supplier_delays")
def q_supplier_delays(spark, d):
    return report.supplier_delays(td.lines(spark, d), td.suppliers(spark, d))


@query("inv_flows")
def q_inv_flows(spark, d):
    return td.dense_flows(spark, d).select("facility_id", "product_id", "snapshot_date",
                                           "received", "consumption", "n_orders")


@query("inv_flows_all_weeks")
def q_inv_flows_all(spark, d):
    """The calendar over every week with a flow: nothing is left out."""
    from supplyrisk.operators import panel
    flows = td.flow_table(spark, d)
    return panel.dense_calendar(flows, ["facility_id", "product_id"], values=td.FLOW_VALUES, bounds=panel.all_weeks(flows)) \
        .select("facility_id", "product_id", "snapshot_date", "received", "consumption", "n_orders")


@query("flow_reconciliation")
def q_flow_reconciliation(spark, d):
    from supplyrisk.operators import panel
    return panel.reconciliation(td.flow_table(spark, d))


@query("inv_rollforward")
def q_inv_rollforward(spark, d):
    return td.inventory_panel(spark, d)


from pyspark.sql import functions as F  # noqa: E402

from supplyrisk.operators import dataset, evaluate, features, labels, risk, split  # noqa: E402

K = ["facility_id", "product_id", "snapshot_date"]


def _inv(spark, d):
    return td.inventory_panel(spark, d)


@query("feat_rolling_4w")
def q_feat_rolling(spark, d):
    return features.rolling_mean(_inv(spark, d)).select(*K, *features.ROLLING_4W.values())


@query("feat_days_of_supply")
def q_feat_dos(spark, d):
    df = features.days_of_supply(features.rolling_mean(_inv(spark, d)))
    return df.select(*K, "closing_stock", "avg_consumption_4w", "days_of_supply")


def _dos_panel(spark, d):
    return features.days_of_supply(features.rolling_mean(_inv(spark, d)))


@query("feat_lags")
def q_feat_lags(spark, d):
    return features.lags(_dos_panel(spark, d)).select(
        *K, "days_of_supply", "dos_lag_1w", "dos_lag_2w", "dos_lag_4w", "dos_trend_2w")


@query("feat_dos_rolling")
def q_feat_dos_rolling(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    df = features.rolling_stats(_dos_panel(spark, d))
    return df.select(*K, round_half_up("dos_mean_4w", 9).alias("dos_mean_4w"),
                     round_half_up("dos_std_4w", 9).alias("dos_std_4w"), "stockout_count_4w")


# ---- the same panel and windows with series of any length: no task holds a whole series -------

from supplyrisk.operators import blocks  # noqa: E402

SERIES = ["facility_id", "product_id"]


@query("inv_rollforward_blocks")
def q_inv_rollforward_blocks(spark, d):
    return td.inventory_blocks(spark, d).drop(blocks.INDEX)


@query("inv_rollforward_brand_blocks")
def q_inv_rollforward_brand_blocks(spark, d):
    return td.inventory_blocks(spark, d, grain="brand_type").drop(blocks.INDEX)


def _by_block(spark, d, fn, before=0, after=0):
    return blocks.windowed(td.inventory_blocks(spark, d), SERIES, fn, td.BLOCK_ROWS, before, after)


def _dos(df, keys):
    return features.days_of_supply(features.rolling_mean(df, keys=keys))


@query("feat_rolling_4w_blocks")
def q_feat_rolling_blocks(spark, d):
    df = _by_block(spark, d, lambda x, k: features.rolling_mean(x, keys=k), before=3)
    return df.select(*K, *features.ROLLING_4W.values())


@query("feat_lags_blocks")
def q_feat_lags_blocks(spark, d):
    """Lags of up to 4 rows of a mean over 4 rows: 7 rows of halo."""
    df = _by_block(spark, d, lambda x, k: features.lags(_dos(x, k), keys=k), before=7)
    return df.select(*K, "days_of_supply", "dos_lag_1w", "dos_lag_2w", "dos_lag_4w", "dos_trend_2w")


@query("feat_dos_rolling_blocks")
def q_feat_dos_rolling_blocks(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    df = _by_block(spark, d, lambda x, k: features.rolling_stats(_dos(x, k), keys=k), before=6)
    return df.select(*K, round_half_up("dos_mean_4w", 9).alias("dos_mean_4w"),
                     round_half_up("dos_std_4w", 9).alias("dos_std_4w"), "stockout_count_4w")


@query("label_next_14d_blocks")
def q_label_blocks(spark, d):
    df = _by_block(spark, d, lambda x, k: labels.next_horizon(x, keys=k), after=2)
    return df.select(*K, "stockout", "stockout_next_14d")


@query("feat_calendar")
def q_feat_calendar(spark, d):
    po = td.with_dates(td.lines(spark, d), spark, d)
    return features.calendar(po, "order_date").select(
        "order_id", "line_number", "order_date", "week_of_year", "month", "q4_flag", "order_week", "order_month")


@query("feat_procurement_28d")
def q_feat_proc(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    daily = td.daily_table(spark, d, lookback=True)
    df = features.procurement_lookback(td.inventory_panel(spark, d, daily=daily), daily=daily)
    return df.select(*K, "po_count_28d", "units_ordered_28d",
                     round_half_up("avg_fill_rate_28d", 9).alias("avg_fill_rate_28d"),
                     "avg_delay_28d", "severe_share_28d")


@query("ml_dataset_full")
def q_ml_dataset_full(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    df = td.ml_dataset_extended(spark, d)
    return df.withColumns({c: round_half_up(c, 9) for c in ("dos_mean_4w", "dos_std_4w", "avg_fill_rate_28d")})


@query("supplier_stats")
def q_supplier_stats(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    st = features.supplier_stats(td.purchase_orders(spark, d))
    return st.select(*K, round_half_up("avg_supplier_reliability", 9).alias("avg_supplier_reliability"),
                     "avg_delay_days", "fulfillment_rate")


@query("feat_supplier_join")
def q_feat_supplier_join(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    # the daily table behind the panel holds the sums that the statistics are ratios of
    daily = td.daily_table(spark, d)
    stats = dataset.supplier_ratios(td.weekly(daily).where(F.col("n_orders") > 0)).withColumnRenamed("week", "snapshot_date") \
        .select(*K, *risk.IMPUTE_COLUMNS)
    j = features.join_supplier_stats(td.inventory_panel(spark, d, daily=daily), stats)
    return j.select(*K, "closing_stock",
                    round_half_up("avg_supplier_reliability", 9).alias("avg_supplier_reliability"),
                    "avg_delay_days", "fulfillment_rate")


@query("enrich_dims")
def q_enrich_dims(spark, d):
    po = td.purchase_orders(spark, d)
    out = features.lookup(po, td.facilities(spark, d), "facility_id", ["facility_name", "region", "facility_beds"])
    out = features.lookup(out, td.products(spark, d), "product_id", ["product_name"])
    out = features.lookup(out, td.suppliers(spark, d), "supplier_id", ["supplier_name"])
    return out.select("order_id", "line_number", "facility_id", "facility_name", "region", "facility_beds",
                      "product_id", "product_name", "category", "critical_item", "supplier_id",
                      "supplier_name", "supplier_reliability")


@query("label_next_14d")
def q_label(spark, d):
    return labels.next_horizon(_inv(spark, d)).select(*K, "stockout", "stockout_next_14d")


@query("label_reorder_14d")
def q_label_reorder(spark, d):
    return labels.reorder_horizon(_inv(spark, d)).select(
        *K, "closing_stock", "safety_stock", "below_reorder_30", "stockout_reorder_14d")


@query("distinct_dates")
def q_distinct_dates(spark, d):
    return td.placed_orders(spark, d).select("order_date").distinct().orderBy("order_date")


# ---- current state and reports ------------------------------------------------

@query("risk_current")
def q_risk_current(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    cur = td.current_scored(spark, d)
    return cur.select(
        "facility_id", "product_id", "snapshot_date", "closing_stock", "stockout", "critical_item",
        "days_of_supply", "stockout_rate_4w",
        round_half_up("avg_supplier_reliability", 9).alias("avg_supplier_reliability"),
        "avg_delay_days", "fulfillment_rate", "facility_beds", "week_of_year", "risk_score", "risk_level")


@query("risk_current_incremental")
def q_risk_current_incremental(spark, d):
    """The state table after four merges, one of them late and one repeated; no statistics imputed."""
    from supplyrisk.functions.scalar import round_half_up
    from supplyrisk.operators import state
    ds = materialize(td.ml_dataset(spark, d), name="history")
    path = sinks.scratch(spark, "state")
    cuts = ["1900-01-01", "1996-06-01", "1998-06-01", "2000-06-01", "2200-01-01"]
    parts = [ds.where((F.col("snapshot_date") >= a) & (F.col("snapshot_date") < b)) for a, b in zip(cuts, cuts[1:])]
    for i in (0, 2, 1, 3, 2):
        state.advance(spark, path, parts[i])
    cur = state.values(state.read(spark, path)).withColumn("critical_item", F.col("critical_item").cast("int"))
    cur = risk.with_level(cur.withColumn("risk_score", risk.formula_score()))
    return cur.select(
        "facility_id", "product_id", "snapshot_date", "closing_stock", "stockout", "critical_item",
        "days_of_supply", "stockout_rate_4w",
        round_half_up("avg_supplier_reliability", 9).alias("avg_supplier_reliability"),
        "avg_delay_days", "fulfillment_rate", "facility_beds", "week_of_year", "risk_score", "risk_level")


@query("risk_level")
def q_risk_level(spark, d):
    return td.current_scored(spark, d).select("facility_id", "product_id", "risk_score", "risk_level")


@query("facility_summary")
def q_facility_summary(spark, d):
    return report.facility_summary(td.current_scored(spark, d), td.facilities(spark, d),
                                   critical_above=0.80, digits=6)


@query("risk_query")
def q_risk_query(spark, d):
    return report.risk_query(td.current_scored(spark, d))


@query("alerts")
def q_alerts(spark, d):
    return report.alerts(td.current_scored(spark, d), td.facilities(spark, d), td.products(spark, d))


@query("stat_strip")
def q_stat_strip(spark, d):
    return report.stat_strip(td.current_scored(spark, d))


@query("supplier_facility_alerts")
def q_sup_fac_alerts(spark, d):
    return report.supplier_facility_alerts(td.with_facility(td.lines(spark, d), spark, d))


@query("risk_search")
def q_risk_search(spark, d):
    return report.risk_search(td.current_scored(spark, d), td.products(spark, d), category="SIZE", text="al")


def _part_names(spark, d):
    return td.read(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("part_name"))


@query("part_search_index")
def q_part_search_index(spark, d):
    """Three searches of part names through the trigram index, and one too short for it."""
    from supplyrisk.operators import search
    path = search.build(_part_names(spark, d), "part_id", "part_name", sinks.scratch(spark, "names-index"))
    return validate.union_all([search.search(spark, path, t).select(F.lit(t).alias("text"), F.col("id").alias("part_id"), "name")
                               for t in ("Bolt brand#1", "RING", "zzz", "le")])


@query("risk_search_index")
def q_risk_search_index(spark, d):
    """The risk table's name search, the names looked up in the index."""
    from supplyrisk.operators import search
    products = td.products(spark, d)
    path = search.build(products, "product_id", "product_name", sinks.scratch(spark, "products-index"))
    hits = products.join(search.search(spark, path, "al").select(F.col("id").alias("product_id")), "product_id", "left_semi")
    cur = td.current_scored(spark, d).join(hits.select("product_id"), "product_id", "left_semi")
    return report.risk_search(cur, products, category="SIZE")


@query("category_stockout_rate")
def q_category(spark, d):
    po = td.with_product(td.lines(spark, d), spark, d, grain="brand_type")
    return report.category_stockout_rate(td.inventory_panel(spark, d, grain="brand_type"), po)


def _test_split(spark, d):
    return split.by_date(td.scored_panel(spark, d), td.TEST_CUTOFF)[1]


@query("facility_risk_summary")
def q_facility_risk_summary(spark, d):
    return report.facility_risk_summary(_test_split(spark, d))


# ---- splits and evaluation ------------------------------------------------------

@query("split_temporal")
def q_split_temporal(spark, d):
    return split.tag(_inv(spark, d), td.TEST_CUTOFF).select(*K, "split")


@query("split_three_way")
def q_split_three_way(spark, d):
    parts = split.three_way(_inv(spark, d), td.VALIDATION_FROM, td.TEST_CUTOFF)
    named = [p.select(*K, F.lit(n).alias("split")) for n, p in zip(("train", "validation", "test"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("split_fractions")
def q_split_fractions(spark, d):
    """Training rows at several fractions, none of them whole percents."""
    inv = _inv(spark, d)
    out = None
    for f in ("0.5", "0.875", "0.995", "0.999"):
        train, test = split.by_fraction(inv, float(f))
        row = train.agg(F.lit(f).alias("fraction"), F.count(F.lit(1)).alias("train_rows"),
                        F.max("snapshot_date").alias("last_train_date"))
        out = row if out is None else out.unionByName(row)
    return out


@query("split_80_20")
def q_split_80_20(spark, d):
    inv = _inv(spark, d)
    cut = split.fraction_cutoff(inv, 0.8)
    c = cut.select("cutoff_date").scalar()
    return cut.select("cutoff_date", "total_rows",
                      inv.where(F.col("snapshot_date") < c).select(F.count(F.lit(1))).scalar().alias("train_rows"))


@query("class_balance")
def q_class_balance(spark, d):
    train = split.by_date(td.ml_dataset(spark, d), td.TEST_CUTOFF)[0]
    return evaluate.class_balance(train)


@query("class_weights")
def q_class_weights(spark, d):
    train = split.by_date(td.ml_dataset(spark, d), td.TEST_CUTOFF)[0]
    return evaluate.class_weights(train).select(*K, "stockout_next_14d", "weight")


@query("eval_confusion")
def q_eval_confusion(spark, d):
    return evaluate.confusion(_test_split(spark, d))


@query("eval_report")
def q_eval_report(spark, d):
    return evaluate.report(_test_split(spark, d))


@query("eval_auc")
def q_eval_auc(spark, d):
    return evaluate.auc(_test_split(spark, d))


@query("eval_average_precision")
def q_eval_ap(spark, d):
    return evaluate.average_precision(_test_split(spark, d))


@query("eval_roc_points")
def q_eval_roc(spark, d):
    return evaluate.roc_points(_test_split(spark, d))


@query("eval_pr_points")
def q_eval_pr(spark, d):
    return evaluate.pr_points(_test_split(spark, d))


@query("eval_tune_threshold")
def q_eval_tune(spark, d):
    """Tuned on the validation year; the test split stays untouched."""
    return evaluate.tune_threshold(split.three_way(td.scored_panel(spark, d), td.VALIDATION_FROM, td.TEST_CUTOFF)[1])


@query("eval_cv_recall")
def q_eval_cv(spark, d):
    """Recall of the formula score per group of series; ``ml_cv_recall`` trains a model per fold."""
    return evaluate.cv_recall(td.scored_panel(spark, d), td.fold_of_series())


@query("label_censored")
def q_label_censored(spark, d):
    """Labels with a fully observed horizon only, and the day-based form beside the row-based one."""
    inv = _inv(spark, d)
    df = labels.next_horizon(inv, drop_censored=True)
    days = labels.next_days(inv, out="stockout_next_14_days").select(*K, "stockout_next_14_days")
    return df.select(*K, "stockout_next_14d").join(days, K)


@query("impute_median")
def q_impute(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    ds = risk.impute_median(td.ml_dataset(spark, d))
    return ds.select(*K, round_half_up("avg_supplier_reliability", 9).alias("avg_supplier_reliability"),
                     "avg_delay_days", "fulfillment_rate")


@query("median_sketches")
def q_median_sketches(spark, d):
    """Medians of calendar years from daily sketches alone, and whether each lies within the error bound
    of the exact ranks."""
    from supplyrisk.functions import sketches
    cols = risk.IMPUTE_COLUMNS
    ds = materialize(td.ml_dataset(spark, d).select("snapshot_date", *cols), name="history")
    days = materialize(sketches.daily(ds, "snapshot_date", cols), name="sketches")
    merged = sketches.merged(days, cols, [F.year("day").alias("year")])
    est = merged.select("year", F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), sketches.count(c).alias("n"), sketches.quantile(c).alias("estimate")) for c in cols])).alias("e")) \
        .select("year", "e.*")
    est = materialize(est, name="estimates")
    long = ds.select(F.year("snapshot_date").alias("year"), F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("p")).select("year", "p.*")
    ranks = long.where(F.col("v").isNotNull()).join(est, ["year", "column_name"]).groupBy("year", "column_name").agg(
        F.first("n").alias("n"), F.count_if(F.col("v") < F.col("estimate")).alias("below"),
        F.count_if(F.col("v") <= F.col("estimate")).alias("upto"), F.count(F.lit(1)).alias("n_rows"))
    eps = sketches.rank_error()
    within = (F.col("below") / F.col("n_rows") <= 0.5 + eps) & (F.col("upto") / F.col("n_rows") >= 0.5 - eps)
    return ranks.select("year", "column_name", "n", "n_rows", within.alias("within_bound"))


# ---- ingest, validation, star schema, sinks --------------------------------------

from supplyrisk.operators import star, validate  # noqa: E402
from supplyrisk.sources import ingest, sinks  # noqa: E402


def _text_ids(df):
    """Integer keys as the text ids of the exports."""
    return df.withColumns({c: S.padded_id(p, F.col(c), 3) for c, p in (("facility_id", "F"), ("supplier_id", "S"))
                           if c in df.columns})


def _orders_export(spark, d):
    po = td.purchase_orders(spark, d)
    po = features.lookup(po, td.facilities(spark, d), "facility_id", ["facility_name", "region", "facility_beds"])
    po = features.lookup(po, td.products(spark, d), "product_id", ["product_name"])
    po = features.lookup(po, td.suppliers(spark, d), "supplier_id", ["supplier_name"])
    return _text_ids(po)


def _through_csv(spark, df, schema, name):
    """Write the schema's columns in another order with one more column, read them back by name."""
    cols = sorted(f.name for f in schema.fields)
    path = sinks.write_csv(df.select(F.lit("x").alias("extra"), *cols), sinks.scratch(spark, name))
    return ingest.read_csv(spark, path, schema)


@query("src_csv_dates")
def q_src_csv(spark, d):
    return _through_csv(spark, _orders_export(spark, d), ingest.ORDERS_SCHEMA, "orders_csv")


@query("src_csv_inventory")
def q_src_csv_inventory(spark, d):
    return _through_csv(spark, _text_ids(_inv(spark, d)), ingest.INVENTORY_SCHEMA, "inventory_csv")


@query("src_csv_ml_dataset")
def q_src_csv_ml(spark, d):
    from supplyrisk.functions.scalar import round_half_up
    df = _through_csv(spark, _text_ids(td.ml_dataset(spark, d)), ingest.ML_SCHEMA, "ml_dataset_csv")
    return df.withColumn("avg_supplier_reliability", round_half_up("avg_supplier_reliability", 9))


def _orders_text(spark, d):
    """Orders export as text; the date text breaks for some rows (month 13-14, day 30 of Feb)."""
    o = td.read(spark, d, "orders")
    bad_date = F.format_string("%d-%d-%d", F.year("o_orderdate"), F.lit(1) + F.col("o_orderkey") % 14,
                               F.dayofmonth("o_orderdate"))
    return o.select(F.col("o_orderkey").cast("string").alias("order_key"),
                    F.col("o_custkey").cast("string").alias("customer_key"),
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_totalprice").cast("string").alias("total_price"),
                    bad_date.alias("order_date"),
                    F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")).alias("priority"))


@query("ingest_typed")
def q_ingest_typed(spark, d):
    from pyspark.sql import types as T
    path = sinks.write_csv(_orders_text(spark, d), sinks.scratch(spark, "orders_text"))
    raw = ingest.read_text_csv(spark, path, ["order_key", "customer_key", "status", "total_price", "order_date", "priority"])
    return ingest.typed(raw, {"order_key": T.LongType(), "customer_key": T.LongType(),
                              "total_price": T.DoubleType(), "order_date": T.DateType()})


def _quarantined(spark, d):
    """The text export split by type errors and two rules; every line is written, some broken on purpose."""
    from pyspark.sql import types as T
    text = _orders_text(spark, d)
    broken = F.col("order_key").cast("long") % 41 == 0
    lines = text.select(F.concat_ws(",", "order_key", "customer_key", "status",
                                    F.when(broken, F.lit(None)).otherwise(F.lit("1.5")),
                                    "order_date", F.coalesce("priority", F.lit(""))).alias("value"))
    header = "order_key,customer_key,status,total_price,order_date,priority"
    path = sinks.scratch(spark, "orders_lines")
    # whole lines as one column named like the header; the separator does not occur
    lines.select(F.col("value").alias(header)).write.option("header", True).option("sep", "\x01").csv(path)
    raw = ingest.read_lines(spark, path, header.split(","))
    return ingest.quarantine(raw, {"order_key": T.LongType(), "customer_key": T.LongType(), "total_price": T.DoubleType(),
                                   "order_date": T.DateType()}, sinks.scratch(spark, "quarantine"),
                             {"priority is given": F.col("priority").isNotNull(), "status is known": F.col("status").isin("F", "O", "P")})


@query("ingest_quarantine")
def q_ingest_quarantine(spark, d):
    """Rejected rows with their reasons and raw line."""
    rejected = _quarantined(spark, d)[1]
    return rejected.select(F.split("raw_line", ",")[0].cast("long").alias("order_key"), "raw_line",
                           F.array_join("reasons", "; ").alias("reasons"))


@query("ingest_quarantine_clean")
def q_ingest_quarantine_clean(spark, d):
    return _quarantined(spark, d)[0]


@query("ingest_profile")
def q_ingest_profile(spark, d):
    """All columns of three sources: the raw line feed, the deliveries and the weekly model table."""
    return validate.union_all([
        ingest.profile(td.raw_feed(spark, d), "procurement"),
        ingest.profile(td.deliveries(spark, d), "deliveries"),
        ingest.profile(td.ml_dataset(spark, d), "inventory"),
    ])


@query("validate_rules")
def q_validate_rules(spark, d):
    """The rules over the raw line feed, before any join could drop a line."""
    return validate.po_rules(td.raw_feed(spark, d))


@query("validate_dates")
def q_validate_dates(spark, d):
    return validate.date_rule(_orders_text(spark, d), "order_date")


@query("validate_ri")
def q_validate_ri(spark, d):
    t = lambda n: td.read(spark, d, n)
    return validate.union_all([
        validate.ri_rule(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "lineitem.l_orderkey -> orders"),
        validate.ri_rule(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders.o_custkey -> customer"),
        validate.ri_rule(t("lineitem"), t("part"), "l_partkey", "p_partkey", "lineitem.l_partkey -> part"),
        validate.ri_rule(t("lineitem"), t("supplier"), "l_suppkey", "s_suppkey", "lineitem.l_suppkey -> supplier"),
        validate.ri_rule(t("documents"), t("labels"), "doc_id", "doc_id", "documents.doc_id -> labels"),
    ])


@query("validate_ri_orphans")
def q_validate_ri_orphans(spark, d):
    return validate.orphans(td.read(spark, d, "documents"), td.read(spark, d, "labels"), "doc_id") \
                   .select("doc_id", "lang", "source")


def _star(spark, d, tables):
    root = sinks.scratch(spark, "star")
    inventory = td.inventory_panel(spark, d) if "fact_inventory" in tables else None
    return star.build(td.purchase_orders(spark, d), td.facilities(spark, d), td.products(spark, d),
                      td.suppliers(spark, d), inventory, root, tables)


@query("star_tables")
def q_star_tables(spark, d):
    """All seven tables written, then counted from their files."""
    paths = _star(spark, d, star.TABLES)
    return validate.union_all([spark.read.parquet(p).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
                               for t, p in paths.items()])


@query("star_fact_delivery")
def q_star_fact_delivery(spark, d):
    return spark.read.parquet(_star(spark, d, ["fact_delivery"])["fact_delivery"])


@query("star_fact_inventory")
def q_star_fact_inventory(spark, d):
    return spark.read.parquet(_star(spark, d, ["fact_inventory"])["fact_inventory"])


@query("join_po_delivery")
def q_join_po_delivery(spark, d):
    paths = _star(spark, d, ["fact_procurement", "fact_delivery"])
    return star.procurement_with_delivery(spark.read.parquet(paths["fact_procurement"]),
                                          spark.read.parquet(paths["fact_delivery"]))


@query("join_po_delivery_bucketed")
def q_join_po_delivery_bucketed(spark, d):
    """The same join from tables stored by line: no shuffle of either fact."""
    lines = star._lines(td.purchase_orders(spark, d), ["fact_procurement", "fact_delivery"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = {}
    for t, fact in (("fact_procurement", star.fact_procurement), ("fact_delivery", star.fact_delivery)):
        path = sinks.scratch(spark, f"{t}-bucketed")
        named[t] = star.save_bucketed(fact(lines), path.rsplit("/", 1)[-1].replace("-", "_"), path, n)
    return star.procurement_with_delivery(spark.table(named["fact_procurement"]), spark.table(named["fact_delivery"]))


def _change_sets(spark, d):
    """The order lines as three change sets: two halves, and corrections of every tenth order, some of which
    move to the next month.  The lines are joined with their orders and parts and written once for all sets."""
    po = td.purchase_orders(spark, d)
    cols = dict.fromkeys(["order_key", *(c for t in star.TABLES for c in star._LINE_COLUMNS.get(t, ()))])
    po = materialize(po.select(*cols), name="order-lines").withColumn("version", F.lit(1))
    k = F.col("order_key")
    late = F.when(k % 50 == 0, F.add_months("order_date", 1)).otherwise(F.col("order_date"))
    fixed = po.where(k % 10 == 0).withColumns({"quantity_received": F.lit(0).cast("bigint"), "fulfilled": F.lit(False),
                                               "order_date": late, "version": F.lit(2)})
    return po.where(k % 2 == 0), po.where(k % 2 == 1), fixed


def _incremental(spark, d):
    root = sinks.scratch(spark, "star")
    even, odd, fixed = _change_sets(spark, d)
    dims = (td.facilities(spark, d), td.products(spark, d), td.suppliers(spark, d))
    for part in (odd, fixed, even, odd):   # corrections come before some of what they correct, one half twice
        paths = star.load(spark, part, *dims, root, written=True)
    return paths


@query("star_incremental")
def q_star_incremental(spark, d):
    return spark.read.parquet(_incremental(spark, d)["fact_delivery"])


@query("star_incremental_tables")
def q_star_incremental_tables(spark, d):
    return validate.union_all([spark.read.parquet(p).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
                               for t, p in _incremental(spark, d).items()])


@query("star_dims")
def q_star_dims(spark, d):
    paths = _star(spark, d, [t for t in star.TABLES if t.startswith("dim_")])
    rd = spark.read.parquet
    return validate.union_all([
        rd(paths["dim_facility"]).select(F.lit("dim_facility").alias("table_name"),
                                         F.col("facility_id").cast("string").alias("member_key"),
                                         F.col("facility_name").alias("label")),
        rd(paths["dim_product"]).select(F.lit("dim_product").alias("table_name"),
                                        F.col("product_id").alias("member_key"),
                                        F.col("product_name").alias("label")),
        rd(paths["dim_supplier"]).select(F.lit("dim_supplier").alias("table_name"),
                                         F.col("supplier_id").cast("string").alias("member_key"),
                                         F.col("supplier_name").alias("label")),
        rd(paths["dim_date"]).select(F.lit("dim_date").alias("table_name"),
                                     F.col("date_key").cast("string").alias("member_key"),
                                     F.date_format("date", "yyyy-MM-dd").alias("label")),
    ])


@query("star_fact_po")
def q_star_fact_po(spark, d):
    return spark.read.parquet(_star(spark, d, ["fact_procurement"])["fact_procurement"])


def _date_range(spark, d):
    orders = td.placed_orders(spark, d)
    return orders.select(F.min("order_date")).scalar(), orders.select(F.max("order_date")).scalar()


def _members(dims):
    """Every member of three dimensions as (dimension, member_key, attributes as JSON-free text)."""
    num = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    txt = lambda *cols: F.concat_ws("|", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cols])
    f, s, p = dims["facilities"], dims["suppliers"], dims["products"]
    return validate.union_all([
        f.select(F.lit("facilities").alias("dimension"), F.col("facility_id").cast("string").alias("member_key"),
                 txt("facility_name", "facility_beds", "region").alias("attributes")),
        s.select(F.lit("suppliers"), F.col("supplier_id").cast("string"),
                 txt("supplier_name", num("reliability"), num("avg_lead_days"))).toDF("dimension", "member_key", "attributes"),
        p.select(F.lit("products"), F.col("product_id").cast("string"),
                 txt("product_name", "category", num("unit_cost"), "critical_item")).toDF("dimension", "member_key", "attributes"),
        dims["date_range"].select(F.lit("date_range"), F.lit("range"), txt("start", "end"))
                          .toDF("dimension", "member_key", "attributes")])


@query("sink_json_metadata")
def q_sink_metadata(spark, d):
    """JSON lines: written and read back, every member of every dimension."""
    path = sinks.write_metadata(td.facilities(spark, d), td.suppliers(spark, d), td.products(spark, d),
                                *_date_range(spark, d), sinks.scratch(spark, "metadata"))
    return _members(ingest.metadata_dimensions(ingest.read_metadata(spark, path)))


@query("src_json_dims")
def q_src_json_dims(spark, d):
    """The single nested document: written and read back, every member of every dimension."""
    path = sinks.write_metadata_document(td.facilities(spark, d), td.suppliers(spark, d), td.products(spark, d),
                                         *_date_range(spark, d), sinks.scratch(spark, "metadata_document"))
    return _members(ingest.read_metadata_document(spark, path))


# ---- model: encoding, training, scoring, metrics ----------------------------------

import hashlib  # noqa: E402
import json  # noqa: E402

from supplyrisk.functions.stats import dense_index  # noqa: E402
from supplyrisk.operators import model as gbm  # noqa: E402


@query("encode_labels")
def q_encode_labels(spark, d):
    inv = _inv(spark, d)
    fac = dense_index(inv, "facility_id", "code").select(
        F.lit("facility_id").alias("column_name"), F.col("facility_id").cast("string").alias("value"), "code")
    prod = dense_index(inv, "product_id", "code").select(
        F.lit("product_id").alias("column_name"), F.col("product_id").alias("value"), "code")
    return fac.unionByName(prod)


def _dictionary(spark, d):
    """A code table grown by two loads: the brand x type products of one part in three, then all."""
    from supplyrisk.operators import dictionary
    parts = td.read(spark, d, "part").select("p_partkey", td.product_key("brand_type").alias("product_id"))
    path = sinks.scratch(spark, "codes")
    first = dictionary.encode(parts, materialize(dictionary.extend(spark, path, parts.where("p_partkey % 3 = 0 and p_partkey < 600"), "product_id"),
                                                 name="codes-then"), "product_id", "code_then")
    dictionary.extend(spark, path, parts, "product_id")
    codes = dictionary.extend(spark, path, parts, "product_id")   # a repeated load adds nothing
    return codes, dictionary.encode(first, codes, "product_id", "code")


@query("dictionary_codes")
def q_dictionary_codes(spark, d):
    return _dictionary(spark, d)[0]


@query("dictionary_rows")
def q_dictionary_rows(spark, d):
    """Every part with its code by the first load's table (-1: not in it yet) and by the second's."""
    return _dictionary(spark, d)[1]


@query("encode_rows")
def q_encode_rows(spark, d):
    """The codes joined back to the panel's rows."""
    inv = _inv(spark, d).select(*K)
    return dataset.encode(dataset.encode(inv, "facility_id", "facility_id_enc"), "product_id", "product_id_enc")


def _model_data(spark, d):
    """The model table with its three nullable columns imputed, written once, and the place of the model that
    belongs to it: a fingerprint of all its rows, taken while they are written, the split and the parameters."""
    seen = Observation()
    ds = td.imputed_dataset(spark, d)
    data = materialize(ds.observe(seen, F.count(F.lit(1)).alias("n"),
                                  F.sum(F.xxhash64(*dataset.FEATURES, dataset.TARGET, "snapshot_date").cast("decimal(38,0)")).alias("h")))
    return data, f"{seen.get['n']}|{seen.get['h']}|{td.TEST_CUTOFF}"


def _model_path(spark, mark, params):
    text = f"{mark}|{json.dumps(params, sort_keys=True)}"
    return f"{checkpoint_dir(spark).rstrip('/')}/models/{hashlib.md5(text.encode()).hexdigest()}"


def _trained(spark, data, mark):
    """The boosted model of the training split, all rounds of ``GB_PARAMS``.

    The model is stored under the shared folder by ``mark`` and its
    parameters, and trained when that is not there: other data or parameters
    never meet an old model.
    """
    train_df = split.by_date(data, td.TEST_CUTOFF)[0].select(*dataset.FEATURES, dataset.TARGET)
    return gbm.stored_or_trained(spark, _model_path(spark, mark, gbm.GB_PARAMS), lambda: gbm.train(train_df))


@query("ml_batch_score")
def q_ml_batch_score(spark, d):
    """Scores of the current state, as facts that hold for any model: the keys and dates scored, the
    probability in range, the band equal to the score's."""
    scored = _scores(spark, d)
    s = F.col("risk_score")
    band = F.when(s <= 0.25, "Low").when(s <= 0.55, "Medium").otherwise("High")
    return scored.select("facility_id", "product_id", "snapshot_date", s.between(0, 1).alias("score_in_range"),
                         (F.col("risk_level") == band).alias("level_fits_score"))


def _scores(spark, d):
    data, mark = _model_data(spark, d)
    cur = risk.current_state(data)
    return risk.with_level(gbm.score(_trained(spark, data, mark), cur)).select(
        "facility_id", "product_id", "snapshot_date", "risk_score", "risk_level")


@query("scores_export")
def q_scores_export(spark, d):
    """The scores written as JSON lines and read back: every key once, with a band."""
    path = sinks.write_scores(td.current_scored(spark, d).select("facility_id", "product_id", "snapshot_date", "risk_score",
                                                                 "risk_level"), sinks.scratch(spark, "scores"))
    return spark.read.schema("facility_id int, product_id string, snapshot_date date, risk_score double, risk_level string").json(path)


@query("ml_scores_export")
def q_ml_scores_export(spark, d):
    """The model's scores of the current state, written as the export file and read back; the stored model,
    loaded again, must give every one of them."""
    data, mark = _model_data(spark, d)
    cur = materialize(risk.current_state(data), name="current")
    scored = risk.with_level(gbm.score(_trained(spark, data, mark), cur))
    cols = ["facility_id", "product_id", "snapshot_date", "risk_score", "risk_level"]
    path = sinks.write_scores(scored.select(*cols), sinks.scratch(spark, "scores"))
    read = spark.read.schema("facility_id int, product_id string, snapshot_date date, risk_score double, risk_level string").json(path)
    again = gbm.score(gbm.load(_model_path(spark, mark, gbm.GB_PARAMS)), cur, out="again").select("facility_id", "product_id", "again")
    s = F.col("risk_score")
    band = F.when(s <= 0.25, "Low").when(s <= 0.55, "Medium").otherwise("High")
    return read.join(again, SERIES).select(*SERIES, "snapshot_date", (F.abs(s - F.col("again")) < 1e-12).alias("same_score"),
                                           (F.col("risk_level") == band).alias("level_fits_score"))


@query("ml_top_feature")
def q_ml_top_feature(spark, d):
    """The most important feature matters: with its values dealt to other rows the test split's AUC falls."""
    data, mark = _model_data(spark, d)
    model = _trained(spark, data, mark)
    top = gbm.importances(model).orderBy(F.desc("importance"), "feature").first()["feature"]
    test = split.by_date(data, td.TEST_CUTOFF)[1].select(*K, *[c for c in dataset.FEATURES if c not in K], dataset.TARGET)
    dealt = Window.partitionBy(F.pmod(F.xxhash64(*K), F.lit(16))).orderBy(F.xxhash64(*K, F.lit(1)))
    moved = test.withColumn(top, F.coalesce(F.lag(top, 7).over(dealt), F.col(top)))
    areas = [evaluate.auc(gbm.score(model, df)).select("roc_auc").scalar() for df in (test, moved)]
    return test.agg(F.count(F.lit(1)).alias("test_rows")).select("test_rows", (areas[0] > areas[1] + 0.01).alias("auc_falls"))


@query("ml_importances")
def q_ml_importances(spark, d):
    """One row per feature; importances are shares of one."""
    imp = materialize(gbm.importances(_trained(spark, *_model_data(spark, d))))
    total = imp.select(F.round(F.sum("importance"), 9)).scalar()
    return imp.select("feature", F.col("importance").between(0, 1).alias("is_share"), total.alias("total"))


def _metrics(spark, d):
    data, mark = _model_data(spark, d)
    train_df, test_df = split.by_date(data, td.TEST_CUTOFF)
    test = materialize(gbm.score(_trained(spark, data, mark), test_df))
    rep = materialize(evaluate.report(test, threshold=gbm.DECISION_THRESHOLD, digits=None))
    cm = materialize(evaluate.confusion(test, threshold=gbm.DECISION_THRESHOLD))
    one = lambda df, c: df.select(c).scalar()
    cls = lambda name, c: rep.where(F.col("class") == name).select(c).scalar()
    cell = lambda a, p: cm.where((F.col("actual") == a) & (F.col("predicted") == p)).select("n").scalar()
    metrics = spark.range(1).select(
        F.round(one(evaluate.auc(test), "roc_auc"), 4).alias("roc_auc"),
        F.round(one(evaluate.average_precision(test, digits=None), "average_precision"), 4).alias("average_precision"),
        F.round(cls("1", "precision"), 4).alias("precision_pos"),
        F.round(cls("1", "recall"), 4).alias("recall_pos"),
        F.round(cls("1", "f1_score"), 4).alias("f1_pos"),
        F.round(cls("accuracy", "precision"), 4).alias("accuracy"),
        train_df.select(F.count(F.lit(1))).scalar().alias("train_samples"),
        test.select(F.count(F.lit(1))).scalar().alias("test_samples"),
        F.round(test.select(F.avg("stockout_next_14d")).scalar(), 4).alias("test_positive_rate"),
        F.lit(td.TEST_CUTOFF).alias("test_cutoff"),
        F.array(F.array(cell(0, 0), cell(0, 1)), F.array(cell(1, 0), cell(1, 1))).alias("confusion_matrix"),
        F.lit(gbm.DECISION_THRESHOLD).alias("decision_threshold"),
        F.array(*[F.lit(f) for f in dataset.FEATURES]).alias("features"))
    path = sinks.write_metrics(metrics, sinks.scratch(spark, "metrics"))
    return spark.read.schema(sinks.METRICS_SCHEMA).json(path)


@query("ml_metrics_roundtrip")
def q_ml_metrics(spark, d):
    """The metrics file read back: what the data fix is returned as it is, the model's own figures as
    the relations that must hold between them."""
    cm = F.flatten("confusion_matrix")
    tn, fp, fn, tp = (F.element_at(cm, i) for i in (1, 2, 3, 4))
    near = lambda a, b: F.abs(a - b) < 6e-5
    return _metrics(spark, d).select(
        "train_samples", "test_samples", "test_positive_rate", "test_cutoff", "decision_threshold",
        F.array_join("features", ",").alias("features"), (tn + fp + fn + tp).alias("confusion_total"), (fn + tp).alias("confusion_positives"),
        near(F.col("recall_pos"), tp / (tp + fn)).alias("recall_fits"),
        near(F.col("precision_pos"), tp / F.greatest(tp + fp, F.lit(1))).alias("precision_fits"),
        near(F.col("accuracy"), (tp + tn) / (tn + fp + fn + tp)).alias("accuracy_fits"),
        (F.col("roc_auc") > 0.9).alias("auc_above_0_9"))


def _cv_folds(spark, d):
    """The boosted model, all rounds, once per fold of series; stored like the main model."""
    data, mark = _model_data(spark, d)
    params = {**gbm.GB_PARAMS, "rows_per_task": 200_000}

    def fit(f, rows):
        rows = rows.select(*dataset.FEATURES, dataset.TARGET)
        return gbm.stored_or_trained(spark, _model_path(spark, f"{mark}|fold {f} of 5", params), lambda: gbm.train(rows, rows_per_task=200_000))
    return gbm.cross_validate(data, td.fold_of_series(), fit=fit)


@query("ml_cv_recall")
def q_ml_cv_recall(spark, d):
    """Five-fold cross-validation of the boosted model, each series on one side only.  Per fold what the
    data fix (its sizes and the sums of its confusion counts) and what must hold of the model's figures."""
    return _cv_folds(spark, d).select(
        F.col("fold").cast("int").alias("fold"), "train_rows", "test_rows", (F.col("tp") + F.col("fn")).alias("positives"),
        (F.col("tn") + F.col("fp")).alias("negatives"),
        (F.abs(F.col("recall") - F.col("tp") / (F.col("tp") + F.col("fn"))) < 1e-12).alias("recall_fits"),
        (F.col("recall") > 0.5).alias("recall_above_half"),
        # a model that calls everything positive has recall 1 and this share of hits
        (F.col("tp") * F.col("test_rows") > (F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn"))).alias("better_than_chance"))


@query("json_records")
def q_json_records(spark, d):
    """The risk table as JSON records, parsed back to typed columns."""
    recs = sinks.json_records(report.risk_query(td.current_scored(spark, d)))
    schema = ("facility_id int, product_id string, closing_stock bigint, days_of_supply double, risk_score double, "
              "risk_level string, critical_item int, stockout_rate_4w double, avg_delay_days double")
    return recs.select(F.from_json("record", schema).alias("r"), F.size(F.json_object_keys("record")).alias("n_fields")) \
               .select("r.*", "n_fields")


@query("json_alerts")
def q_json_alerts(spark, d):
    """The alert envelope, parsed back: its total and every alert at its place."""
    env = sinks.alerts_envelope(report.alerts(td.current_scored(spark, d), td.facilities(spark, d), td.products(spark, d)))
    alert = ("struct<facility_id:int,facility_name:string,product_id:string,product_name:string,risk_score:double,"
             "closing_stock:bigint,days_of_supply:double,avg_delay_days:double,stockout_rate_4w:double>")
    doc = env.select(F.from_json("record", f"total_alerts bigint, alerts array<{alert}>").alias("e"))
    return doc.select("e.total_alerts", F.posexplode("e.alerts").alias("place", "a")) \
              .select("total_alerts", (F.col("place") + 1).alias("place"), "a.*")


# ---- projections over the order table -------------------------------------------


@query("proj_seasonal")
def q_proj_seasonal(spark, d):
    dates = td.placed_orders(spark, d).select("order_date").distinct()
    return dates.select("order_date", F.dayofyear("order_date").alias("day_of_year"),
                        S.round_half_up(S.seasonal_multiplier("order_date"), 12).alias("seasonal_multiplier"))


@query("proj_line_cost")
def q_proj_line_cost(spark, d):
    return td.with_product(td.lines(spark, d), spark, d).select("order_id", "line_number", "quantity_ordered", "unit_cost",
                                                                "unit_cost_total")


@query("proj_delivery_dates")
def q_proj_delivery_dates(spark, d):
    po = td.with_dates(td.lines(spark, d), spark, d)
    return po.select("order_id", "line_number", "order_date", "lead_days_planned", "delay_days",
                     "expected_delivery", "actual_delivery",
                     F.date_format("expected_delivery", "yyyy-MM-dd").alias("expected_text"),
                     F.date_format("actual_delivery", "yyyy-MM-dd").alias("actual_text"))


@query("proj_order_id")
def q_proj_order_id(spark, d):
    return td.lines(spark, d).select("order_key", "order_id").distinct()


@query("proj_partial_receipt")
def q_proj_partial_receipt(spark, d):
    return td.lines(spark, d).select("order_id", "line_number", "line_status", "fulfilled", "quantity_ordered",
                                     "quantity_received", "delay_days")


@query("proj_safety_stock")
def q_proj_safety_stock(spark, d):
    """Facility scale beds/300, seasonal demand index and safety stock int(scale*60)."""
    placed = td.facility_of_order(spark, d, td.placed_orders(spark, d))
    weeks = placed.select("facility_id", S.week_start("order_date").alias("week")).distinct()
    fac = td.facilities(spark, d)
    j = weeks.join(fac.select("facility_id", "facility_beds"), "facility_id")
    scale = F.col("facility_beds") / F.lit(300.0)
    return j.select("facility_id", "week",
                    S.round_half_up(scale, 12).alias("facility_scale"),
                    S.round_half_up(scale * S.seasonal_multiplier("week"), 12).alias("demand_index"),
                    S.int_floor(scale * F.lit(60.0)).alias("safety_stock"))


@query("proj_delay_severity")
def q_proj_delay_severity(spark, d):
    po = td.lines(spark, d)
    return po.select("order_id", "line_number", "delay_days", S.delay_severe("delay_days").alias("delay_severe"),
                     S.delay_band("delay_days").alias("delay_band"))


@query("proj_coverage_bucket")
def q_proj_coverage_bucket(spark, d):
    df = _dos_panel(spark, d)
    return df.select(*K, "days_of_supply", S.coverage_bucket("days_of_supply").alias("coverage_bucket"))


@query("risk_query_filtered")
def q_risk_query_filtered(spark, d):
    return report.risk_query(td.current_scored(spark, d), facility_id=3, risk_level="Low", critical_only="true")


@query("inv_rollforward_brand")
def q_inv_rollforward_brand(spark, d):
    """The roll-forward at brand x type grain: the panel grows with the data."""
    return td.inventory_panel(spark, d, grain="brand_type")
