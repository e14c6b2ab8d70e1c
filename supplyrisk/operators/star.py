"""Star schema: dimensions, facts and their parquet layout.

Seven tables: ``dim_facility``, ``dim_product``, ``dim_supplier``,
``dim_date`` and the facts ``fact_procurement``, ``fact_delivery``,
``fact_inventory``.  Facts are written partitioned by month (partition
pruning on date filters) and sorted by (facility, product) inside each
file (min/max statistics let the parquet reader skip row groups: the
file-format stand-in for the indexes on facility, SKU, date, supplier).
Range partitioning before the write keeps the number of files per month
bounded without sending a whole month to one task.

``build`` writes whole tables from one pass over the order lines;
``load`` brings a change set into tables that are there already and touches
only the months concerned.
"""

from __future__ import annotations

import os

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyrisk.functions.scalar import month_start
from supplyrisk.plans import files
from supplyrisk.plans.materialize import materialize


def date_key(c) -> "F.Column":
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def dim_date(po: DataFrame) -> DataFrame:
    d = po.select(F.col("order_date").alias("date")).distinct()
    return d.select(date_key("date").alias("date_key"), "date",
                    F.weekofyear("date").alias("week_of_year"), F.month("date").alias("month"),
                    F.quarter("date").alias("quarter"), F.year("date").alias("year"))


def _used(dim: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Dimension members that the lines use."""
    return dim.join(lines.select(key).distinct(), key, "left_semi")


_DIMS = {
    "dim_facility": lambda lines, facilities, products, suppliers: _used(facilities, lines, "facility_id"),
    "dim_product": lambda lines, facilities, products, suppliers: _used(products, lines, "product_id"),
    "dim_supplier": lambda lines, facilities, products, suppliers: _used(suppliers, lines, "supplier_id"),
    "dim_date": lambda lines, facilities, products, suppliers: dim_date(lines),
}


def fact_procurement(lines: DataFrame, *more: str) -> DataFrame:
    return lines.select("order_id", "line_number", "facility_id", "product_id", "supplier_id",
                        date_key("order_date").alias("date_key"), "quantity_ordered", "unit_cost_total", *more,
                        month_start("order_date").alias("order_month"))


def fact_delivery(lines: DataFrame, *more: str) -> DataFrame:
    return lines.select("order_id", "line_number", "facility_id", "product_id", "supplier_id",
                        date_key("expected_delivery").alias("expected_date_key"),
                        date_key("actual_delivery").alias("actual_date_key"), "quantity_received",
                        "delay_days", "fulfilled", *more, month_start("order_date").alias("order_month"))


_FACTS = {"fact_procurement": fact_procurement, "fact_delivery": fact_delivery}


def write_fact(df: DataFrame, path: str, month_col: str, tail: list[str] | None = None,
               num_partitions: int | None = None, mode: str = "overwrite", months_only: bool = False) -> str:
    """Month-partitioned parquet, sorted by (facility, product) inside files.

    The range key ends with ``tail`` (a line id or a date), so the range
    bounds can cut inside one (month, facility, product) group: a group
    holding a large share of the rows is written by several tasks.
    ``months_only`` replaces the months of ``df`` and leaves the others.
    """
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    key = [month_col, "facility_id", "product_id", *(tail or [])]
    (df.repartitionByRange(int(n), *key)
       .sortWithinPartitions(*key)
       .write.mode(mode).option("partitionOverwriteMode", "dynamic" if months_only else "static")
       .partitionBy(month_col).parquet(path))
    return path


TABLES = ("dim_facility", "dim_product", "dim_supplier", "dim_date",
          "fact_procurement", "fact_delivery", "fact_inventory")

# Columns of the order lines that each table needs.
_KEY_COLUMNS = {"dim_facility": ("facility_id",), "dim_product": ("product_id",), "dim_supplier": ("supplier_id",),
                "dim_date": ("order_date",)}
_LINE = ("order_id", "line_number", "facility_id", "product_id", "supplier_id", "order_date")
_LINE_COLUMNS = {**_KEY_COLUMNS, "fact_procurement": (*_LINE, "quantity_ordered", "unit_cost_total"),
                 "fact_delivery": (*_LINE, "expected_delivery", "actual_delivery", "quantity_received", "delay_days", "fulfilled")}
_TAIL = {"fact_procurement": ("order_month", ["order_id", "line_number"]),
         "fact_delivery": ("order_month", ["order_id", "line_number"]),
         "fact_inventory": ("snapshot_month", ["snapshot_date"])}


def _lines(po: DataFrame, tables: Sequence[str], more: Sequence[str] = (), written: bool = False) -> DataFrame:
    """The columns of the order lines that ``tables`` need, written once when several tables read them
    (``written``: they come from a written table).

    ``po`` joins the lines with orders, customers and parts; facts, used
    members and dates all come from these columns, so the joins run once.
    """
    used = [t for t in tables if t in _LINE_COLUMNS]
    cols = dict.fromkeys([*(c for t in used for c in _LINE_COLUMNS[t]), *more])
    out = po.select(*cols)
    return materialize(out, name="order-lines") if len(used) > 1 and not written else out


def build(po: DataFrame, facilities: DataFrame, products: DataFrame, suppliers: DataFrame,
          inventory: DataFrame | None, root: str, tables: Sequence[str] = TABLES) -> dict[str, str]:
    """Write ``tables`` under ``root``; returns table -> path.  ``fact_inventory`` needs ``inventory``."""
    unknown = [t for t in tables if t not in TABLES or (t == "fact_inventory" and inventory is None)]
    if unknown:
        raise ValueError(f"no source given for {', '.join(unknown)}")
    lines = _lines(po, tables) if any(t in _LINE_COLUMNS for t in tables) else None
    paths = {name: os.path.join(root, name) for name in tables}
    for name, path in paths.items():
        if name == "fact_inventory":
            month, tail = _TAIL[name]
            write_fact(inventory.withColumn(month, month_start("snapshot_date")), path, month, tail)
        elif name in _TAIL:
            write_fact(_FACTS[name](lines), path, *_TAIL[name])
        else:
            _DIMS[name](lines, facilities, products, suppliers).write.mode("overwrite").parquet(path)
    return paths


# ---- incremental load -----------------------------------------------------------

def _set_versions(changes: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(rows of each order's highest version, that version per order) of a change set.

    A set of one version, the common case, is taken as it is: no row moves.
    """
    lo, hi = changes.agg(F.min(version), F.max(version)).first()
    if lo == hi:
        return changes, changes.select(F.col(key).alias("_k")).distinct().withColumn("_newest", F.lit(hi))
    newest = materialize(changes.groupBy(F.col(key).alias("_k")).agg(F.max(version).alias("_newest")), name="versions")
    latest = changes.join(newest, F.col(key) == F.col("_k")).where(F.col(version) == F.col("_newest")).drop("_k", "_newest")
    return materialize(latest, name="changes"), newest


def _marks(df: DataFrame, key: str, columns: Sequence[str], suffix: str) -> DataFrame:
    """Per order its rows' number and two sums over their hashes; NULL sums (an overflow) are equal to none."""
    sums = [F.try_sum(F.shiftright(F.xxhash64(F.lit(seed), *columns), 8)) for seed in (0, 1)]
    return df.groupBy(F.col(key).alias("_k")).agg(*[c.alias(f"_{n}{suffix}") for n, c in zip("nab", (F.count(F.lit(1)), *sums))])


def _in(month_col: str, months: Sequence) -> "F.Column":
    """Is the month among ``months``, None included?"""
    hit = F.col(month_col).isin([m for m in months if m is not None])
    return F.coalesce(hit, F.lit(None in months))


def _by_month(m) -> tuple:
    return m is not None, m


def merge_fact(spark: SparkSession, changes: DataFrame, path: str, month_col: str, tail: list[str],
               key: str = "order_id", version: str = "version", key_fixes_month: bool = False) -> list:
    """Bring a change set into a month-partitioned fact table; returns the months concerned.

    The unit of change is a whole order: of every ``key`` the rows of its
    highest ``version`` stay, and rows of an equal version replace those
    there.  So a set may be loaded again, after a failure too, and sets may
    come in any order.  What is to be done follows from keys and versions
    alone: months that hold older rows of the set's orders are read and
    replaced, other months get new files beside theirs, and an order that is
    there with the same rows (their number and 112 bits of hash sums) is left
    alone.  Finding the orders reads the key and version columns of the
    table, unless ``key_fixes_month`` says that an order never changes its month.
    """
    changes = changes.where(F.col(key).isNotNull() & F.col(version).isNotNull())
    latest, newest = _set_versions(changes, key, version)
    come_to = _months(latest, month_col)   # bounded by the calendar
    if not files.exists(spark, path):
        write_fact(latest, path, month_col, tail)
        return come_to
    old = spark.read.parquet(path)
    held = old.select(F.col(key).alias("_k"), version, month_col)
    if key_fixes_month:
        held = held.where(_in(month_col, come_to))
    held = materialize(held.join(newest, "_k").groupBy("_k", "_newest", month_col)
                           .agg(F.min(version).alias("_low"), F.max(version).alias("_held")), name="held")
    known = _months(held, month_col)
    gone, keep = held.where("_low <= _newest"), held.where("_held > _newest").select("_k")
    equal = held.where("_held = _newest").select("_k")
    if not equal.isEmpty():
        there = _marks(old.join(equal, F.col(key) == F.col("_k"), "left_semi"), key, old.columns, "_old")
        given = _marks(latest, key, old.columns, "_new")
        is_same = F.coalesce(F.expr(" and ".join(f"_{c}_old = _{c}_new" for c in "nab")), F.lit(False))
        judged = materialize(given.join(there, "_k", "left").select("_k", is_same.alias("_same")), name="same")
        if judged.where("not _same").isEmpty():   # the whole set is there
            return sorted({*come_to, *known}, key=_by_month)
        same = judged.where("_same").select("_k")
        gone, keep = gone.join(same, "_k", "left_anti"), keep.unionAll(same)
        gone = materialize(gone, name="gone")
    come = latest.select(*old.columns)
    if not keep.isEmpty():
        come = come.join(keep.withColumnRenamed("_k", key), key, "left_anti").select(*old.columns)
    months = _months(gone, month_col)
    if months:
        stay = old.where(_in(month_col, months)).join(gone.select("_k", "_newest").distinct(), F.col(key) == F.col("_k"), "left") \
                  .where(F.col("_newest").isNull() | (F.col(version) > F.col("_newest"))).select(*old.columns)
        folder = {m: os.path.join(path, f"{month_col}={'__HIVE_DEFAULT_PARTITION__' if m is None else m}") for m in months}
        before = {m: files.children(spark, f) for m, f in folder.items()}
        # a month's old files go when the new ones are complete, so the months can be read while they are written
        write_fact(stay.unionByName(come.where(_in(month_col, months))), path, month_col, tail, months_only=True)
        for m, f in folder.items():
            if files.children(spark, f) == before[m]:   # not written: all of its rows moved to other months
                files.delete(spark, f)
        come = come.where(~_in(month_col, months))
    if set(come_to) - set(months):
        write_fact(come, path, month_col, tail, mode="append")
    return sorted({*come_to, *known}, key=_by_month)


def _months(df: DataFrame, month_col: str) -> list:
    """Distinct months, bounded by the calendar."""
    return [r[0] for r in df.select(month_col).distinct().collect()]


def append_members(spark: SparkSession, members: DataFrame, path: str, key: str) -> None:
    """Add the members that a dimension table does not have yet."""
    members = members.dropDuplicates([key])
    if files.exists(spark, path):
        members = materialize(members.join(spark.read.parquet(path).select(key), key, "left_anti"), name="members")
    members.write.mode("append").parquet(path)


def load(spark: SparkSession, po: DataFrame, facilities: DataFrame, products: DataFrame, suppliers: DataFrame, root: str,
         version: str = "version", key_fixes_month: bool = False, written: bool = False) -> dict[str, str]:
    """Bring a change set of order lines into the star schema under ``root``: the two facts with ``version``
    (``merge_fact``), and the members and dates that it is the first to use.  Loading a set again, or sets
    in another order, ends in the same tables.  ``written`` says that ``po`` reads a written table, which
    needs no copy."""
    tables = [t for t in TABLES if t in _LINE_COLUMNS]
    lines = _lines(po, tables, [version], written)
    paths = {name: os.path.join(root, name) for name in tables}
    for name, path in paths.items():
        if name in _TAIL:
            changes = _FACTS[name](lines, version)
            merge_fact(spark, changes, path, *_TAIL[name], version=version, key_fixes_month=key_fixes_month)
        else:
            key = "date_key" if name == "dim_date" else _KEY_COLUMNS[name][0]
            append_members(spark, _DIMS[name](lines, facilities, products, suppliers), path, key)
    return paths


def procurement_with_delivery(procurement: DataFrame, delivery: DataFrame) -> DataFrame:
    """Each purchase-order line with its delivery record (equi-join on the line)."""
    keys = ["order_id", "line_number"]
    cols = ["expected_date_key", "actual_date_key", "quantity_received", "delay_days", "fulfilled"]
    return procurement.join(delivery.select(*keys, *cols), keys)


# ---- facts stored for the join ---------------------------------------------------

def save_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = ("order_id", "line_number")) -> str:
    """Write a fact as the catalog table ``table``, bucketed by its line keys and sorted by them inside the buckets.

    Two facts stored alike join on the keys without a shuffle of either (``procurement_with_delivery`` on
    ``spark.table``); Spark still sorts inside a bucket, which finds the rows in order.  ``buckets`` is a property of the stored tables, sized to their data (100-200 MB each).
    One task writes each bucket, so a bucket is one file.
    """
    df.repartition(buckets, *keys).write.mode("overwrite").option("path", path) \
      .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return table
