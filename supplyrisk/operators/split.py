"""Chronological train/test splits."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_date(df: DataFrame, cutoff: str, date_col: str = "snapshot_date"):
    """(train, test): rows before ``cutoff`` and rows on/after it."""
    d = F.col(date_col)
    c = F.lit(cutoff).cast("date")
    return df.where(d < c), df.where(d >= c)


def tag(df: DataFrame, cutoff, date_col: str = "snapshot_date", out: str = "split") -> DataFrame:
    c = cutoff if not isinstance(cutoff, str) else F.lit(cutoff).cast("date")
    return df.withColumn(out, F.when(F.col(date_col) < c, F.lit("train")).otherwise(F.lit("test")))


def fraction_cutoff(df: DataFrame, fraction: float = 0.8, date_col: str = "snapshot_date") -> DataFrame:
    """First date whose cumulative row share reaches ``fraction`` (one row).

    Rows are first counted per date, so the running sum is over distinct
    dates only (bounded by the calendar, not by the data).
    """
    per_date = df.groupBy(F.col(date_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy())
    cum = per_date.withColumns({"cum": F.sum("n").over(w), "total": total})
    share = Fraction(str(fraction))   # exact: the decimal that was written, in integers
    wide = "decimal(38,0)"
    hit = cum.where(F.col("cum").cast(wide) * F.lit(share.denominator) >= F.lit(share.numerator) * F.col("total").cast(wide))
    return hit.agg(F.min("d").alias("cutoff_date"), F.first("total").alias("total_rows"))


def by_fraction(df: DataFrame, fraction: float = 0.8, date_col: str = "snapshot_date"):
    """(train, test) with the cutoff of ``fraction_cutoff``: train is strictly before it."""
    cut = fraction_cutoff(df, fraction, date_col).select("cutoff_date").scalar()
    return df.where(F.col(date_col) < cut), df.where(F.col(date_col) >= cut)


def three_way(df: DataFrame, validation_from: str, test_from: str, date_col: str = "snapshot_date"):
    """(train, validation, test) by date: thresholds are tuned on the second, reported on the third."""
    train, rest = by_date(df, validation_from, date_col)
    validation, test = by_date(rest, test_from, date_col)
    return train, validation, test
