"""Typed scans of raw exports and the ingest profile.

Schemas are declared, never inferred.  ``typed`` turns an all-text frame
into typed columns with ``try_cast`` / ``try_to_date`` and counts the
cells that failed to convert, so bad input is reported by the validation
step instead of failing the read.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMAT = "yyyy-MM-dd"


_TYPES = {"string": T.StringType, "bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType,
          "boolean": T.BooleanType, "date": T.DateType}


def _schema(text: str) -> T.StructType:
    """A flat schema from ``name type, ...`` (needs no session, unlike a DDL string)."""
    return T.StructType([T.StructField(n, _TYPES[t]()) for n, t in (c.split() for c in text.split(", "))])


# Columns of the three exports, as their files name them.
ORDERS_SCHEMA = _schema(
    "order_id string, facility_id string, facility_name string, region string, facility_beds bigint, "
    "product_id string, product_name string, category string, critical_item boolean, unit_cost double, "
    "supplier_id string, supplier_name string, supplier_reliability double, order_date date, "
    "expected_delivery date, actual_delivery date, quantity_ordered bigint, quantity_received bigint, "
    "lead_days_planned bigint, delay_days bigint, fulfilled boolean, unit_cost_total double")
INVENTORY_SCHEMA = _schema(
    "snapshot_date date, facility_id string, product_id string, opening_stock bigint, received bigint, "
    "consumption bigint, closing_stock bigint, safety_stock bigint, stockout int, below_safety int, "
    "critical_item boolean")
ML_SCHEMA = T.StructType(INVENTORY_SCHEMA.fields + _schema(
    "avg_consumption_4w double, avg_received_4w double, stockout_rate_4w double, below_safety_rate_4w double, "
    "days_of_supply double, avg_supplier_reliability double, avg_delay_days double, fulfillment_rate double, "
    "facility_beds bigint, stockout_next_14d int, week_of_year int").fields)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a header CSV (of its first file)."""
    return spark.read.option("header", True).csv(path).columns


def _by_name(header: Sequence[str], schema: T.StructType, path: str) -> T.StructType:
    """``schema`` in the file's order, unknown columns as text; raises on missing ones."""
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path}: missing column(s) {', '.join(missing)}")
    known = {f.name: f for f in schema.fields}
    return T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, date_format: str = DATE_FORMAT,
             corrupt_column: str | None = None) -> DataFrame:
    """Header CSV with an explicit schema, columns taken by name; dates parsed with ``date_format``.

    The header decides which column is which: reordered files read the
    same, further columns are left out, missing ones raise.  All files under
    ``path`` must have the first file's header (Spark checks it, as the
    schema is not enforced by position).  With ``corrupt_column`` malformed
    lines are kept (PERMISSIVE) and the raw text lands in that column.
    """
    full = _by_name(csv_header(spark, path), schema, path)
    names = [f.name for f in schema.fields]
    if corrupt_column:
        full = T.StructType(full.fields + [T.StructField(corrupt_column, T.StringType())])
        names.append(corrupt_column)
    r = (spark.read.schema(full).option("header", True).option("enforceSchema", bool(corrupt_column))
         .option("dateFormat", date_format).option("mode", "PERMISSIVE"))
    if corrupt_column:
        r = r.option("columnNameOfCorruptRecord", corrupt_column)
    return r.csv(path).select(*names)


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header CSV with every column as text (for typed conversion later), by name."""
    return read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def _convert(c: Column, dtype: T.DataType, date_format: str) -> Column:
    if isinstance(dtype, T.DateType):
        return F.try_to_date(c, date_format)
    return c.try_cast(dtype)


def typed(df: DataFrame, types: Mapping[str, T.DataType], date_format: str = "yyyy-M-d",
          errors_col: str = "cast_errors") -> DataFrame:
    """Convert text columns to ``types``; count non-NULL cells that became NULL."""
    conv = {c: _convert(F.col(c), t, date_format) for c, t in types.items()}
    errs = sum(((F.col(c).isNotNull() & e.isNull()).cast("int") for c, e in conv.items()), F.lit(0))
    return df.withColumns({**conv, errors_col: errs})


def read_lines(spark: SparkSession, path: str, columns: Sequence[str], raw_col: str = "raw_line") -> DataFrame:
    """Header CSV as text columns with each row's own line, malformed lines included.

    Lines are read as text and parsed one by one, so a quoted line break
    ends its row here; ``read_csv`` reads those.  A line with more or fewer
    cells than the header has its columns NULL.
    """
    header = csv_header(spark, path)
    schema = _by_name(header, T.StructType([T.StructField(c, T.StringType()) for c in columns]), path)
    fields = ", ".join(f"`{c}` string" for c in schema.fieldNames())
    cells = F.from_csv(F.col(raw_col), f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    first = spark.read.text(path).first()   # the header line, of every file
    lines = spark.read.text(path).withColumnRenamed("value", raw_col)
    lines = lines.where(F.col(raw_col) != F.lit(first[0] if first else "")) if first else lines
    parsed = lines.withColumn("_c", cells)
    ok = F.col("_c._bad").isNull()
    return parsed.select(*[F.when(ok, F.col(f"_c.`{c}`")).alias(c) for c in columns], raw_col, (~ok).alias("is_malformed"))


def reasons(types: Mapping[str, T.DataType], checks: Mapping[str, Column] | None = None, date_format: str = "yyyy-M-d",
            malformed: str | None = "is_malformed") -> Column:
    """Why a text row is rejected, as an array of names: a malformed line, cells that are not of their type,
    and checks (conditions on the converted columns, NULL counts as failing) that do not hold."""
    found = [F.when(F.col(malformed), F.lit("malformed line"))] if malformed else []
    ok = ~F.col(malformed) if malformed else F.lit(True)
    for c, t in types.items():
        bad = F.col(c).isNotNull() & _convert(F.col(c), t, date_format).isNull()
        found.append(F.when(ok & bad, F.lit(f"{c}: not a {t.simpleString()}")))
    for name, check in (checks or {}).items():
        found.append(F.when(ok & ~F.coalesce(check, F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*found))


def quarantine(df: DataFrame, types: Mapping[str, T.DataType], path: str, checks: Mapping[str, Column] | None = None,
               date_format: str = "yyyy-M-d", raw_col: str = "raw_line",
               malformed: str | None = "is_malformed") -> tuple[DataFrame, DataFrame]:
    """Split text rows into (clean, rejected), written in one pass under ``path``.

    Clean rows have ``types``; rejected ones keep their text columns, their
    raw line and ``reasons``.  Every input row is in exactly one of them.
    ``checks`` are conditions on the text columns (cast them as needed).
    """
    spark = df.sparkSession
    tagged = df.withColumn("reasons", reasons(types, checks, date_format, malformed))
    tagged.withColumn("is_rejected", F.size("reasons") > 0).write.mode("overwrite").partitionBy("is_rejected").parquet(path)
    both = spark.read.schema(T.StructType(tagged.schema.fields + [T.StructField("is_rejected", T.BooleanType())])).parquet(path)
    drop = [c for c in ("is_rejected", malformed) if c]
    clean = both.where(~F.col("is_rejected")).withColumns({c: _convert(F.col(c), t, date_format) for c, t in types.items()})
    return clean.drop(*drop, "reasons", raw_col), both.where("is_rejected").drop(*drop)


def profile(df: DataFrame, source: str) -> DataFrame:
    """Shape and NULL count per column in one pass, long form:
    (source, column_name, n_rows, n_nulls)."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', _z{i}" for i, c in enumerate(cols))
    return one.select(F.lit(source).alias("source"), F.col("_n").alias("n_rows"),
                      F.expr(f"stack({len(cols)}, {pairs}) AS (column_name, n_nulls)")) \
              .select("source", "column_name", "n_rows", "n_nulls")


# ---- metadata -----------------------------------------------------------------

META_SCHEMA = T.StructType([
    T.StructField("dimension", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("beds", T.LongType()),
    T.StructField("region", T.StringType()),
    T.StructField("reliability", T.DoubleType()),
    T.StructField("avg_lead_days", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("unit_cost", T.DoubleType()),
    T.StructField("critical", T.BooleanType()),
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata written by ``sinks.write_metadata`` (JSON lines, one member per line)."""
    return spark.read.schema(META_SCHEMA).json(path)


def read_metadata_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The source pipeline's single nested document
    ``{facilities: {id: {...}}, suppliers: {...}, products: {...}, date_range: {...}}``
    as dimension DataFrames (map column exploded to rows)."""
    fac = T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()), T.StructField("beds", T.LongType()),
        T.StructField("region", T.StringType())]))
    sup = T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()), T.StructField("reliability", T.DoubleType()),
        T.StructField("avg_lead_days", T.DoubleType())]))
    prod = T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()), T.StructField("category", T.StringType()),
        T.StructField("unit_cost", T.DoubleType()), T.StructField("critical", T.BooleanType())]))
    rng = T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])
    schema = T.StructType([T.StructField("facilities", fac), T.StructField("suppliers", sup),
                           T.StructField("products", prod), T.StructField("date_range", rng)])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)

    def dim(col: str, key: str) -> DataFrame:
        return (doc.select(F.explode(col).alias(key, "v"))
                   .select(key, "v.*"))

    return {
        "facilities": dim("facilities", "facility_id").withColumnRenamed("name", "facility_name")
                                                       .withColumnRenamed("beds", "facility_beds"),
        "suppliers": dim("suppliers", "supplier_id").withColumnRenamed("name", "supplier_name"),
        "products": dim("products", "product_id").withColumnRenamed("name", "product_name")
                                                  .withColumnRenamed("critical", "critical_item"),
        "date_range": doc.select(F.to_date("date_range.start").alias("start"),
                                 F.to_date("date_range.end").alias("end")),
    }


def metadata_dimensions(meta: DataFrame) -> dict[str, DataFrame]:
    """Typed dimension frames from the JSON-lines metadata."""
    m = meta
    return {
        "facilities": m.where("dimension = 'facilities'").select(
            F.col("id").alias("facility_id"), F.col("name").alias("facility_name"),
            F.col("beds").alias("facility_beds"), "region"),
        "suppliers": m.where("dimension = 'suppliers'").select(
            F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "reliability", "avg_lead_days"),
        "products": m.where("dimension = 'products'").select(
            F.col("id").alias("product_id"), F.col("name").alias("product_name"), "category", "unit_cost",
            F.col("critical").alias("critical_item")),
        "date_range": m.where("dimension = 'date_range'").select(
            F.to_date("start").alias("start"), F.to_date("end").alias("end")),
    }


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
               date_format: str = DATE_FORMAT) -> DataFrame:
    """Read one raw export with an explicit schema (csv, json or parquet)."""
    if fmt == "csv":
        return read_csv(spark, path, schema, date_format)
    if fmt == "json":
        return spark.read.schema(schema).option("dateFormat", date_format).json(path)
    return spark.read.schema(schema).parquet(path)
