"""Codes of categorical values that stay the same from load to load.

``dataset.encode`` numbers the values of one frame; another frame, with one
value more, numbers them differently, and a model trained on the first reads
nonsense from the second.  A code table is written once and only grows: new
values get the next numbers, in sorted order among themselves, and a value
keeps its code for good.  ``freeze`` stores the table with a model.

One load at a time may extend a table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyrisk.functions.stats import dense_index
from supplyrisk.plans import files
from supplyrisk.plans.materialize import materialize

UNKNOWN = -1


def read(spark: SparkSession, path: str) -> DataFrame:
    """(value, code) of a code table."""
    return spark.read.schema("value string, code bigint").parquet(path)


def extend(spark: SparkSession, path: str, df: DataFrame, col: str) -> DataFrame:
    """Add the values of ``col`` that the table does not have; returns the table.

    Values are compared as text, NULL is no value.  Running it again adds nothing.
    """
    seen = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    base = F.lit(0).cast("bigint")
    if files.exists(spark, path):
        codes = read(spark, path)
        seen = seen.join(codes.select("value"), "value", "left_anti")
        base = F.coalesce(codes.select(F.max("code") + 1).scalar(), base)
    # numbered and written aside first: the table itself is read here
    fresh = materialize(dense_index(seen, "value", "place").select("value", (F.col("place") + base).alias("code")), name="codes")
    fresh.write.mode("append").parquet(path)
    return read(spark, path)


def encode(df: DataFrame, codes: DataFrame, col: str, out: str, unknown: int | None = UNKNOWN) -> DataFrame:
    """Add the code of ``col``; a value that the table does not have gets ``unknown``, NULL stays NULL."""
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(named, F.col(col).cast("string") == F.col("_value"), "left")
    code = F.when(F.col(col).isNull(), F.lit(None)).otherwise(F.coalesce(F.col("_code"), F.lit(unknown).cast("bigint")))
    return joined.withColumn(out, code).drop("_value", "_code")


def decode(df: DataFrame, codes: DataFrame, col: str, out: str) -> DataFrame:
    """Add the value of a code column; NULL for ``UNKNOWN`` and NULL."""
    named = codes.select(F.col("code").alias("_code"), F.col("value").alias(out))
    return df.join(named, F.col(col) == F.col("_code"), "left").drop("_code")


def freeze(spark: SparkSession, path: str, model_path: str, name: str) -> str:
    """Store the table as it is now inside a model's folder, where ``of_model`` finds it."""
    to = os.path.join(model_path, "codes", name)
    read(spark, path).write.mode("overwrite").parquet(to)
    return to


def of_model(spark: SparkSession, model_path: str, name: str) -> DataFrame:
    """The codes that a model was trained with."""
    return read(spark, os.path.join(model_path, "codes", name))
