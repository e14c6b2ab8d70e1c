"""Connected components of a link table, by alternating star contractions.

Links are rewritten until every member points at the smallest id it can
reach: a large-star step hangs the larger neighbours of a node on the
smallest neighbour, a small-star step hangs the smaller ones there.  The
number of rounds grows with the logarithm of a component's size.  Each
step aggregates minima before it shuffles, so a node with very many links
is no hot task, and every round is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyrisk.plans import materialize


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """``both`` has (u, v); links (v, m) with m the smallest of u and its neighbours."""
    m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(m, "u")
    out = out.filter("v > u").select("v", "m") if larger else \
        out.filter("v != m").select("v", "m").unionAll(m.filter("u != m").select(F.col("u").alias("v"), "m"))
    return out.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id in ``links``; component_id is the smallest id reached."""
    one = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    one = materialize(one, name="links")
    state = None
    while True:
        mark = one.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (mark["n"], mark["h"]):
            break
        state = (mark["n"], mark["h"])
        both = one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger=True)
        one = materialize(_star(large, larger=False), name="links")
    roots = one.select("v").distinct()
    return one.select(F.col("u").alias("id"), F.col("v").alias("component_id")) \
              .unionAll(roots.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
