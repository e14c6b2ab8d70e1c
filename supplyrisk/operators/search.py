"""Substring search over names by an index of trigrams.

``report.risk_search`` tests every name.  The index holds, per trigram of a
lower-cased name, the ids that have it, in folders by a hash of the trigram.
A search reads the folders of its own trigrams only, keeps the ids that have
all of them, and tests their names with ``contains``.  Texts of fewer than
three characters have no trigram; for them every name is tested.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-cased text."""
    low = F.lower(text)
    n = F.length(low) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))) \
            .otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def build(df: DataFrame, id_col: str, text_col: str, path: str, buckets: int = BUCKETS) -> str:
    """Write the index of ``text_col`` under ``path``: postings by trigram folder, and the names by id.

    A frequent trigram is spread over the tasks of its folder by id.
    """
    names = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("name")).where(F.col("name").isNotNull())
    grams = names.select("id", F.explode(trigrams(F.col("name"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    grams.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id") \
         .write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(path, "postings"))
    names.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(os.path.join(path, "names"))
    df.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1) \
      .write.mode("overwrite").parquet(os.path.join(path, "settings"))
    return path


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """Ids whose names have every trigram of ``text``; None when it has none."""
    buckets = spark.read.parquet(os.path.join(path, "settings")).first()["buckets"]
    one = spark.range(1).select(F.explode(trigrams(F.lit(text))).alias("gram")).select("gram", _bucket(F.col("gram"), buckets).alias("b"))
    asked = one.collect()   # the trigrams of one search text
    if not asked:
        return None
    id_type = spark.read.parquet(os.path.join(path, "names")).schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("gram", T.StringType()), T.StructField("bucket", T.IntegerType())])
    postings = spark.read.schema(schema).parquet(os.path.join(path, "postings"))
    hits = postings.where(F.col("bucket").isin(sorted({r["b"] for r in asked})) & F.col("gram").isin([r["gram"] for r in asked]))
    return hits.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(asked)).select("id")


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(id, name) of the names that contain ``text``, whatever the case."""
    names = spark.read.parquet(os.path.join(path, "names"))
    ids = candidates(spark, path, text)
    if ids is not None:
        names = names.join(ids, "id")
    return names.where(F.contains(F.lower("name"), F.lower(F.lit(text))))
