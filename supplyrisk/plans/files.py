"""Paths of written tables, asked of the path's own file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """False when ``to`` is there already."""
    fs, p = _path(spark, path)
    return not exists(spark, to) and fs.rename(p, _path(spark, to)[1])


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none when it is not there."""
    fs, p = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    fs, p = _path(spark, path)
    fs.create(p, True).close()
