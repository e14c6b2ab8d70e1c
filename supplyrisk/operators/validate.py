"""Validation: referential integrity, business rules and date parsing.

Every check is an aggregate that returns one report row per rule
``(rule, violations, checked)``; ``assert_valid`` is the action that
stops a pipeline with a descriptive error.  Orphans are found with
``left_anti`` joins (shuffle or broadcast, chosen at run time).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    pass


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key has no parent row."""
    pk = parent_key or child_key
    return child.join(parent.select(F.col(pk).alias(child_key)), child_key, "left_anti")


def ri_rule(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    """Orphans and rows checked in one pass over the child.

    The child is counted per key before the join, so a hot key is one row,
    and the parent's keys come in by a left join with a marker.
    """
    keys = child.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    j = keys.join(known, "_k", "left")
    lost = F.col("_hit").isNull()
    return j.agg(F.lit(rule).alias("rule"),
                 F.coalesce(F.sum(F.when(lost, F.col("_n"))), F.lit(0)).cast("bigint").alias("violations"),
                 F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("checked"),
                 F.min(F.when(lost, F.col("_k").cast("string"))).alias("example_key"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rules(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Count rows failing each named condition (NULL counts as failing)."""
    names = list(checks)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(~F.coalesce(checks[k], F.lit(False))).alias(f"_v{i}") for i, k in enumerate(names)])
    pairs = ", ".join(f"'{k}', _v{i}" for i, k in enumerate(names))
    return one.select(F.expr(f"stack({len(names)}, {pairs}) AS (rule, violations)"), F.col("_n").alias("checked"))


def po_rules(po: DataFrame) -> DataFrame:
    """Business rules of the procurement feed."""
    fill = F.col("quantity_received") / F.nullif(F.col("quantity_ordered"), F.lit(0))
    return rules(po, {
        "quantity_ordered_positive": F.col("quantity_ordered") > 0,
        "quantity_received_non_negative": F.col("quantity_received") >= 0,
        "fill_rate_in_unit_interval": fill.between(0, 1),
        "delay_days_non_negative": F.col("delay_days") >= 0,
    })


def date_rule(df: DataFrame, col: str, fmt: str = "yyyy-M-d", rule: str | None = None) -> DataFrame:
    """Text dates that do not parse (NULL text is not counted)."""
    bad = F.col(col).isNotNull() & F.try_to_date(F.col(col), fmt).isNull()
    return df.agg(F.lit(rule or f"{col}_parses").alias("rule"), F.count_if(bad).alias("violations"),
                  F.count(F.lit(1)).alias("checked"))


def assert_valid(report: DataFrame) -> DataFrame:
    """Raise ``ValidationError`` naming every rule with violations; else return the report."""
    bad = report.where(F.col("violations") > 0).select("rule", "violations").collect()
    if bad:
        msg = "; ".join(f"{r['rule']}: {r['violations']} violation(s)" for r in bad)
        raise ValidationError(f"validation failed: {msg}")
    return report


def report(po: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """Validation report of the procurement feed (or of custom ``checks``)."""
    return rules(po, checks) if checks else po_rules(po)
