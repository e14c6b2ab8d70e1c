"""Series cut into time blocks: equal to the whole-series windows, with no task holding a series."""

import datetime
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from supplyrisk.operators import blocks as B
from supplyrisk.operators import features, labels, panel
from supplyrisk.plans import plan_text

START = datetime.date(1995, 1, 2)


def _frame(spark, series):
    """{key: [(received, consumption), ...]} as a dense weekly frame."""
    rows = [(k, START + datetime.timedelta(days=7 * i), r, c, i) for k, xs in series.items() for i, (r, c) in enumerate(xs)]
    return spark.createDataFrame(rows, f"k string, snapshot_date date, received bigint, consumption bigint, {B.INDEX} bigint")


def _loop(series, opening):
    out = {}
    for k, xs in series.items():
        s = int(opening(sum(c for _, c in xs) / len(xs)) // 1)
        for i, (r, c) in enumerate(xs):
            out[k, i] = (s, max(0, s + r - c))
            s = out[k, i][1]
    return out


def _rolled(df, n, per_group=None):
    got = B.roll_forward(df, ["k"], lambda m: F.floor(F.lit(2.0) * m), n, blocks_per_group=per_group)
    return {(r["k"], r[B.INDEX]): (r["opening_stock"], r["closing_stock"]) for r in got.collect()}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40), n=st.integers(1, 9),
       per_group=st.sampled_from([None, 1, 2, 3]))
def test_roll_forward_equals_the_recurrence(spark, xs, n, per_group):
    series = {"a": xs, "b": xs[::-1], "c": [(0, 50), *xs, (7, 0)]}
    assert _rolled(_frame(spark, series), n, per_group) == _loop(series, lambda m: 2 * m)


def test_one_series_holding_nearly_all_rows(spark):
    rng = random.Random(3)
    series = {"hot": [(rng.randint(0, 20), rng.randint(0, 21)) for _ in range(5000)], "x": [(1, 3)] * 4, "y": [(0, 0)]}
    df = _frame(spark, series)
    assert _rolled(df, 64, per_group=8) == _loop(series, lambda m: 2 * m)
    sizes = df.withColumn(B.BLOCK, F.floor(F.col(B.INDEX) / 64)).groupBy("k", B.BLOCK).count().agg(F.max("count")).first()[0]
    assert sizes == 64


def test_halos_give_the_whole_series_windows(spark):
    rng = random.Random(4)
    series = {k: [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)] for k, n in (("a", 57), ("b", 8), ("c", 1), ("d", 7))}
    df = _frame(spark, series).withColumns({"stockout": (F.col("received") == 0).cast("int"), "below_safety": (F.col("received") < 3).cast("int"),
                                            "closing_stock": F.col("received") * 3})

    def fn(x, keys):
        x = features.days_of_supply(features.rolling_mean(x, keys=keys))
        return labels.next_horizon(features.rolling_stats(features.lags(x, keys=keys), keys=keys), keys=keys)

    want = fn(df, ["k"])
    for n in (1, 3, 7, 8, 60):
        got = B.windowed(df, ["k"], fn, n, before=7, after=2).select(want.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_counted_index_of_irregular_series(spark):
    days = {"a": [0, 1, 5, 30, 31, 90, 200], "b": [3], "c": list(range(0, 400, 13))}
    rows = [(k, START + datetime.timedelta(days=d), d % 7, d % 5) for k, ds in days.items() for d in ds]
    df = spark.createDataFrame(rows, "k string, snapshot_date date, received bigint, consumption bigint")
    indexed = B.counted_index(df, ["k"], "snapshot_date")
    at = {(r["k"], r["snapshot_date"]): r[B.INDEX] for r in indexed.collect()}
    assert at == {(k, START + datetime.timedelta(days=d)): i for k, ds in days.items() for i, d in enumerate(ds)}
    series = {k: [(d % 7, d % 5) for d in ds] for k, ds in days.items()}
    assert _rolled(indexed, 4, per_group=2) == _loop(series, lambda m: 2 * m)


@pytest.mark.parametrize("n", [1, 5, 16, 1000])
def test_calendar_by_blocks(spark, n):
    rng = random.Random(5)
    rows = [(k, START + datetime.timedelta(days=7 * rng.randint(0, 30)), rng.randint(0, 5), 1, rng.randint(0, 1)) for k in "abc" for _ in range(9)]
    flows = spark.createDataFrame(rows, "k string, week date, received bigint, consumption bigint, n_orders bigint") \
        .groupBy("k", "week").agg(*[F.sum(c).alias(c) for c in panel.FLOW_COLS])
    got = B.dense_calendar(flows, ["k"], n)
    want = panel.dense_calendar(flows, ["k"])
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
    assert got.where(F.col(B.BLOCK) != F.floor(F.col(B.INDEX) / n)).count() == 0


def test_no_window_over_a_whole_series(spark):
    df = _frame(spark, {"a": [(1, 2)] * 9})
    stepped = B.stepped(df.withColumn(B.BLOCK, F.floor(F.col(B.INDEX) / 4)), ["k"])
    halo = B.windowed(df, ["k"], lambda x, k: features.rolling_mean(x, {"received": "m"}, keys=k), 4, before=3)
    for plan in (plan_text(stepped, "simple"), plan_text(halo, "simple")):
        # long plan nodes are cut off in text, so look at the shuffle that feeds the window
        shuffles = [line for line in plan.splitlines() if "hashpartitioning(" in line]
        assert shuffles and all(B.BLOCK in line for line in shuffles)
    empty = df.limit(0)
    assert _rolled(empty, 4, per_group=2) == {}
