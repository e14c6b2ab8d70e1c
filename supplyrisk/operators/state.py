"""The current state kept as a table and merged with what is new.

``risk.current_state`` takes, per series and column, the last non-NULL value
by date, from the whole history.  That is a maximum over (date, value), so it
can be kept: the state table holds per series and column the pair
(date, value), and new rows are reduced to the same form and merged in.  The
merge is associative, commutative and idempotent; a week may come late,
twice, or in parts.

A merge writes the next version beside the current one (``00000007`` after
``00000006``) and a version counts once it is complete, so readers keep
their version and a merge that fails is simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyrisk.plans import files

KEYS = ("facility_id", "product_id")
_DATE = "last_date"


def reduced(df: DataFrame, keys: Sequence[str] = KEYS, date_col: str = "snapshot_date") -> DataFrame:
    """Per series: its last date, and per column the (date, value) of its last non-NULL value.

    Of two values of one date the larger stays.
    """
    cols = [c for c in df.columns if c not in (*keys, date_col)]
    d = F.col(date_col)
    return df.groupBy(*keys).agg(
        F.max(d).alias(_DATE),
        *[F.max(F.when(F.col(c).isNotNull() & d.isNotNull(), F.struct(d.alias("d"), F.col(c).alias("v")))).alias(c) for c in cols])


def merged(states: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """One state of several, of the same columns."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])


def values(state: DataFrame, keys: Sequence[str] = KEYS, date_col: str = "snapshot_date") -> DataFrame:
    """The state as ``risk.current_state`` returns it: one value per column."""
    cols = [c for c in state.columns if c not in (*keys, _DATE)]
    return state.select(*keys, F.col(_DATE).alias(date_col), *[F.col(f"{c}.v").alias(c) for c in cols])


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a state table, oldest first."""
    return [v for v in files.children(spark, path) if files.exists(spark, f"{path}/{v}/_SUCCESS")]


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The newest complete version of the state (or the one named)."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path}: no state yet")
    return spark.read.parquet(f"{path}/{version or found[-1]}")


def advance(spark: SparkSession, path: str, new_rows: DataFrame, keys: Sequence[str] = KEYS,
            date_col: str = "snapshot_date", keep: int = 2) -> str:
    """Merge new rows into the state under ``path``; returns the new version.

    Reads the state (a row per series) and the new rows, never the history.
    The oldest versions beyond ``keep`` are deleted.
    """
    before = versions(spark, path)
    state = reduced(new_rows, keys, date_col)
    if before:
        state = merged([read(spark, path, before[-1]), state], keys)
    name = f"{int(before[-1]) + 1 if before else 1:08d}"
    state.write.mode("overwrite").parquet(f"{path}/{name}")
    for old in before[:max(0, len(before) + 1 - keep)]:
        files.delete(spark, f"{path}/{old}")
    return name
