"""Distributed order statistics: two-level prefix sums, global ranks, exact quantiles.

A running sum over a *global* order (no partition key) would move every
row into one task.  Here the rows are range-partitioned on the order key
(Spark samples the keys and places rows by binary search over the
sampled bounds, so ranges are balanced), the partition id becomes the
bucket and the table is written once, which pins it.  The running sum
runs inside each bucket (a partitioned window) and each bucket adds the
total of the buckets before it, a window over one row per bucket.  The
bucket count follows ``spark.sql.shuffle.partitions``, which a cluster
sizes to its data.  Exact for any input; inputs must be grouped so that
the order key is unique (one row per distinct score or value).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyrisk.plans.materialize import materialize


def prefix_sums(df: DataFrame, order: str, values: Sequence[str], descending: bool = False,
                buckets: int | None = None, prefix: str = "cum_", rank_col: str | None = "idx",
                partition_by: Sequence[str] = (), next_values: bool = False) -> DataFrame:
    """Inclusive running sums of ``values`` along ``order`` over the whole frame
    (or within each ``partition_by`` group).

    ``rank_col`` gets the 0-based position in the order.  ``next_values``
    adds ``next_<value>``, the value of the row that follows (NULL after the
    last); the row before needs no column, as its sum is the sum less the value.
    """
    values = list(values)
    part = list(partition_by)
    spark = df.sparkSession
    n_b = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    ordering = F.col(order).desc() if descending else F.col(order).asc()
    # Buckets are contiguous ranges of (groups, order); the id is pinned by the write.
    # The input is a grouped aggregate: the range exchange's sampling job and
    # the shuffle both read the aggregate's shuffle output, so the upstream
    # plan still runs once.
    x = materialize(df.repartitionByRange(n_b, *[F.col(c).asc() for c in part], ordering)
                      .withColumn("_b", F.spark_partition_id()))
    tot = (x.groupBy(*part, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values],
                                     F.count(F.lit(1)).alias("_t_n"),
                                     *[(F.max_by if descending else F.min_by)(v, order).alias(f"_f_{v}") for v in values if next_values]))
    bw = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part, "_b",
                      *[F.coalesce(F.sum(f"_t_{v}").over(bw), F.lit(0)).alias(f"_o_{v}") for v in values],
                      F.coalesce(F.sum("_t_n").over(bw), F.lit(0)).alias("_o_n"),
                      *[F.lead(f"_f_{v}").over(Window.partitionBy(*part).orderBy("_b")).alias(f"_x_{v}") for v in values if next_values])
    iw = Window.partitionBy(*part, "_b").orderBy(ordering).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = x.withColumns({f"_i_{v}": F.sum(v).over(iw) for v in values})
    if next_values:
        inner = inner.withColumns({f"_l_{v}": F.lead(v).over(Window.partitionBy(*part, "_b").orderBy(ordering)) for v in values})
    if rank_col:
        inner = inner.withColumn("_i_n", F.row_number().over(Window.partitionBy(*part, "_b").orderBy(ordering)))
    # Without groups ``offs`` has one row per bucket, a size set by the bucket count; with groups it
    # grows with them, and the join strategy is left to the run-time sizes.
    j = inner.join(offs if part else F.broadcast(offs), [*part, "_b"])
    cols = {f"{prefix}{v}": F.col(f"_o_{v}") + F.col(f"_i_{v}") for v in values}
    if rank_col:
        cols[rank_col] = F.col("_o_n") + F.col("_i_n") - F.lit(1)
    drop = ["_b", *[f"_i_{v}" for v in values], *[f"_o_{v}" for v in values], "_o_n"]
    if next_values:
        # the last row of a bucket is followed by the first of the next one
        cols.update({f"next_{v}": F.coalesce(f"_l_{v}", f"_x_{v}") for v in values})
        drop += [f"_{a}_{v}" for a in "lx" for v in values]
    if rank_col:
        drop.append("_i_n")
    return j.withColumns(cols).drop(*drop)


def dense_index(df: DataFrame, col: str, out: str | None = None, buckets: int | None = None) -> DataFrame:
    """Distinct values of ``col`` with their 0-based position in sorted order."""
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    return prefix_sums(d, col, [], buckets=buckets, rank_col=out or f"{col}_index")


def exact_quantile(df: DataFrame, col: str, q: float = 0.5, buckets: int | None = None) -> Column:
    """Exact ``percentile(col, q)`` (linear interpolation, NULLs skipped) as a scalar Column."""
    return exact_quantiles(df, [col], q, buckets)[col]


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5, buckets: int | None = None) -> dict[str, Column]:
    """Exact quantiles of several columns in one pipeline, never gathered in one task.

    The columns are stacked into (column, value) pairs and counted per
    distinct value (map-side partial counts).  One grouped ``prefix_sums``
    positions the values, and the two order statistics around ``q*(n-1)``
    are the rows whose cumulative counts bracket them.  The result, one row
    per column, is written and read as scalar subqueries.  The same steps
    run at any size.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_g"), F.col(c).cast("double").alias("_v"))
                                for c in cols])).alias("_p")
    long = df.select(pairs).select("_p._g", "_p._v").where(F.col("_v").isNotNull())
    counts = materialize(long.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c")))
    pos = prefix_sums(counts, "_v", ["_c"], buckets=buckets, rank_col=None, partition_by=["_g"])
    p = F.lit(float(q)) * (F.col("_n") - F.lit(1))
    totals = counts.groupBy("_g").agg(F.sum("_c").alias("_n")).select("_g", p.alias("_p"))

    def at(rank: Column) -> Column:
        """The value at a 0-based rank."""
        return F.max(F.when((F.col("cum__c") - F.col("_c") <= rank) & (rank < F.col("cum__c")), F.col("_v")))

    found = pos.join(totals, "_g").groupBy("_g").agg(
        F.first("_p").alias("_p"), at(F.floor("_p")).alias("_lo"), at(F.ceil("_p")).alias("_hi"))
    # the interpolation of ``percentile``, term by term, so that results are equal to the last bit
    between = (F.ceil("_p") - F.col("_p")) * F.col("_lo") + (F.col("_p") - F.floor("_p")) * F.col("_hi")
    out = materialize(found.select("_g", F.when(F.floor("_p") == F.ceil("_p"), F.col("_lo")).otherwise(between).alias("_q")))
    return {c: out.where(F.col("_g") == c).select("_q").scalar() for c in cols}
