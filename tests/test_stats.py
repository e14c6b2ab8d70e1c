import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

from supplyrisk.functions.stats import dense_index, exact_quantile, exact_quantiles, prefix_sums


def test_two_level_prefix_sum_equals_global(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 100, 500)
    keys = rng.permutation(500).astype(float)
    df = spark.createDataFrame([(float(k), int(v)) for k, v in zip(keys, vals)], "k double, v long")
    got = {r.k: (r.cum_v, r.idx) for r in prefix_sums(df, "k", ["v"], buckets=8).collect()}
    want = df.withColumn("c", F.sum("v").over(Window.orderBy("k")))
    for r in want.collect():
        assert got[r.k][0] == r.c
    assert sorted(i for _, i in got.values()) == list(range(500))


@pytest.mark.parametrize("vals", [[3.0, 1.0, 2.0], [4.0, 1.0, 3.0, 2.0], [5.0] * 7 + [1.0, 9.0], [2.5]])
def test_exact_median(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = df.select(exact_quantile(df, "x", 0.5, buckets=4).alias("m")).first().m
    assert got == pytest.approx(float(np.median(vals)))


def test_dense_index_strings(spark):
    df = spark.createDataFrame([(s,) for s in ["pear", "apple", "fig", "apple", "Zed", None]], "s string")
    got = {r.s: r.code for r in dense_index(df, "s", "code", buckets=3).collect()}
    assert got == {"Zed": 0, "apple": 1, "fig": 2, "pear": 3}


def test_exact_quantiles_of_two_columns(spark):
    a = [3.0, 1.0, 2.0, 8.0, None]
    b = [5.0, 5.0, 5.0, 1.0, 9.0]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    meds = exact_quantiles(df, ["a", "b"], 0.5, buckets=3)
    r = df.select(meds["a"].alias("ma"), meds["b"].alias("mb")).first()
    assert (r.ma, r.mb) == (2.5, 5.0)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-5, 5, width=32)), min_size=1, max_size=25),
       st.sampled_from([0.25, 0.5, 0.9]), st.sampled_from([1, 3, 8]))
def test_exact_quantile_equals_percentile_to_the_bit(spark, vals, q, buckets):
    present = [v for v in vals if v is not None]
    if not present:
        return
    df = spark.createDataFrame([(v,) for v in vals + [0.1, 0.7]], "x double")
    got = df.select(exact_quantile(df, "x", q, buckets=buckets).alias("m")).first().m
    assert got == df.select(F.percentile("x", q)).first()[0]
    assert got == pytest.approx(float(np.percentile(present + [0.1, 0.7], q * 100)))


def test_exact_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(exact_quantile(df, "x").alias("m")).first().m is None


def test_next_values_cross_buckets(spark):
    from supplyrisk.functions.stats import prefix_sums
    rows = [(g, i, i * i % 7) for g in "ab" for i in range(50)] + [("c", 1, 4)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    for descending in (False, True):
        got = {(r["g"], r["o"]): r["next_v"] for r in prefix_sums(df, "o", ["v"], descending=descending, buckets=7, partition_by=["g"],
                                                                  next_values=True).collect()}
        step = -1 if descending else 1
        assert got == {(g, o): dict(((a, b), c) for a, b, c in rows).get((g, o + step)) for g, o, _ in rows}
