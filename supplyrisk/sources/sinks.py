"""Sinks: CSV exports, metadata, metrics and JSON records.

Nothing is gathered on the driver: metadata is written as JSON lines
(one dimension member per line) so a dimension of any size stays
distributed; only the alerts envelope nests rows, and it holds at most
its row limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyrisk.plans.materialize import scratch  # noqa: F401  (a path for a sink's output)


def write_csv(df: DataFrame, path: str, date_format: str = "yyyy-MM-dd", mode: str = "overwrite") -> str:
    """Header CSV, dates as ``date_format`` text (the exports' layout)."""
    (df.write.mode(mode).option("header", True).option("dateFormat", date_format).csv(path))
    return path


def write_metadata(facilities: DataFrame, suppliers: DataFrame, products: DataFrame,
                   start, end, path: str, mode: str = "overwrite") -> str:
    """Dimension members and the date range as JSON lines.

    ``start`` / ``end`` are date Columns (e.g. scalar subqueries over the
    order table).
    """
    def rec(df: DataFrame, dim: str, id_col: str, **cols) -> DataFrame:
        fields = {"dimension": F.lit(dim), "id": F.col(id_col).cast("string")}
        fields.update(cols)
        return df.select(*[v.alias(k) for k, v in fields.items()])

    fac = rec(facilities, "facilities", "facility_id", name=F.col("facility_name"),
              beds=F.col("facility_beds").cast("bigint"), region=F.col("region"))
    sup = rec(suppliers, "suppliers", "supplier_id", name=F.col("supplier_name"),
              reliability=F.col("reliability"), avg_lead_days=F.col("avg_lead_days"))
    prod = rec(products, "products", "product_id", name=F.col("product_name"), category=F.col("category"),
               unit_cost=F.col("unit_cost"), critical=F.col("critical_item"))
    one = facilities.sparkSession.range(1)
    rng = one.select(F.lit("date_range").alias("dimension"), F.lit(None).cast("string").alias("id"),
                     F.date_format(start, "yyyy-MM-dd").alias("start"),
                     F.date_format(end, "yyyy-MM-dd").alias("end"))
    allrec = fac.unionByName(sup, allowMissingColumns=True).unionByName(prod, allowMissingColumns=True) \
                .unionByName(rng, allowMissingColumns=True)
    allrec.write.mode(mode).json(path)
    return path


def write_metadata_document(facilities: DataFrame, suppliers: DataFrame, products: DataFrame, start, end, path: str,
                            max_members: int = 100_000) -> str:
    """The single nested document that ``ingest.read_metadata_document`` reads.

    One document is one row, so the dimensions must be small: more than
    ``max_members`` members in one raise; ``write_metadata`` has no bound.
    """
    def members(df: DataFrame, key: str, **cols) -> "F.Column":
        if df.count() > max_members:
            raise ValueError(f"{key}: more than {max_members} members for one document; use write_metadata")
        pair = F.struct(F.col(key).cast("string").alias("key"),
                        F.struct(*[F.col(c).alias(n) for n, c in cols.items()]).alias("value"))
        return df.select(F.map_from_entries(F.array_sort(F.collect_list(pair)))).scalar()

    doc = facilities.sparkSession.range(1).select(
        members(facilities, "facility_id", name="facility_name", beds="facility_beds", region="region").alias("facilities"),
        members(suppliers, "supplier_id", name="supplier_name", reliability="reliability",
                avg_lead_days="avg_lead_days").alias("suppliers"),
        members(products, "product_id", name="product_name", category="category", unit_cost="unit_cost",
                critical="critical_item").alias("products"),
        F.struct(F.date_format(start, "yyyy-MM-dd").alias("start"),
                 F.date_format(end, "yyyy-MM-dd").alias("end")).alias("date_range"))
    doc.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> str:
    metrics.coalesce(1).write.mode(mode).json(path)
    return path


def json_records(df: DataFrame, col: str = "record") -> DataFrame:
    """One JSON object per row (``orient="records"``), null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(col))


def alerts_envelope(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """``{"total_alerts": n, "alerts": [...]}`` as one JSON string, highest risk first.

    At most ``limit`` alerts are listed, the feature's own bound, so the
    list fits one row; without alerts the total is 0 and the list empty.
    """
    rec_cols = [c for c in alerts.columns if c != "total_alerts"]
    order = [F.col("risk_score").desc(), F.col("facility_id"), F.col("product_id")]
    rank = F.row_number().over(Window.orderBy(*order))   # over the cut list only
    top = alerts.orderBy(*order).limit(limit).withColumn("_rank", rank)
    one = top.agg(F.coalesce(F.max("total_alerts"), F.lit(0)).cast("bigint").alias("total_alerts"),
                  F.array_sort(F.collect_list(F.struct("_rank", F.struct(*rec_cols).alias("r")))).alias("x"))
    return one.select(F.to_json(F.struct("total_alerts", F.transform("x", lambda x: x["r"]).alias("alerts")),
                                {"ignoreNullFields": "false"}).alias("record"))


METRICS_SCHEMA = T.StructType([
    T.StructField("roc_auc", T.DoubleType()), T.StructField("average_precision", T.DoubleType()),
    T.StructField("precision_pos", T.DoubleType()), T.StructField("recall_pos", T.DoubleType()),
    T.StructField("f1_pos", T.DoubleType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("train_samples", T.LongType()), T.StructField("test_samples", T.LongType()),
    T.StructField("test_positive_rate", T.DoubleType()), T.StructField("test_cutoff", T.StringType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("decision_threshold", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.StringType())),
])


def write_scores(scored: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Scores export: one JSON object per facility x product row."""
    scored.write.mode(mode).json(path)
    return path
