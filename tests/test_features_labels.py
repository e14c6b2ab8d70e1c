import datetime as dt

import pytest

from supplyrisk.operators import features, labels

D0 = dt.date(2024, 1, 1)
SCHEMA = "facility_id int, product_id string, snapshot_date date, consumption long, received long, stockout int, below_safety int, closing_stock long"


def frame(spark, key, cons, closing=None, stockout=None):
    closing = closing or [10] * len(cons)
    stockout = stockout or [0] * len(cons)
    return [(key, "P", D0 + dt.timedelta(weeks=i), c, 0, s, 0, cl)
            for i, (c, s, cl) in enumerate(zip(cons, stockout, closing))]


@pytest.mark.parametrize("n", [1, 3, 4, 6])
def test_rolling_mean_min_periods_one(spark, n):
    cons = [4, 8, 0, 12, 20, 2][:n]
    df = spark.createDataFrame(frame(spark, 1, cons), SCHEMA)
    got = [r.avg_consumption_4w for r in features.rolling_mean(df).orderBy("snapshot_date").collect()]
    want = [sum(cons[max(0, i - 3):i + 1]) / len(cons[max(0, i - 3):i + 1]) for i in range(n)]
    assert got == pytest.approx(want)


def test_days_of_supply_zero_divisor_and_cap(spark):
    df = spark.createDataFrame(frame(spark, 1, [0, 0, 1], closing=[7, 7, 100]), SCHEMA)
    df = features.days_of_supply(features.rolling_mean(df))
    got = [r.days_of_supply for r in df.orderBy("snapshot_date").collect()]
    # zero mean counts as 1; 100 / (1/3) = 300 is capped at 60
    assert got == [7.0, 7.0, 60.0]
    per_day = features.days_of_supply(features.rolling_mean(
        spark.createDataFrame(frame(spark, 1, [7], closing=[7]), SCHEMA)), per_day=True)
    assert per_day.first().days_of_supply == 7.0


def test_lags_and_trend(spark):
    df = spark.createDataFrame(frame(spark, 1, [1] * 6, closing=[1, 2, 3, 4, 5, 6]), SCHEMA)
    df = features.lags(features.days_of_supply(features.rolling_mean(df)))
    rows = df.orderBy("snapshot_date").collect()
    assert [r.dos_lag_1w for r in rows] == [None, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert [r.dos_lag_4w for r in rows] == [None, None, None, None, 1.0, 2.0]
    assert [r.dos_trend_2w for r in rows] == [None, None, 2.0, 2.0, 2.0, 2.0]


def _label(spark, stockouts, **kw):
    rows = frame(spark, 1, [1] * len(stockouts), stockout=stockouts)
    df = spark.createDataFrame(rows, SCHEMA)
    return [r.stockout_next_14d for r in labels.next_horizon(df, **kw).orderBy("snapshot_date").collect()]




def test_label_positions(spark):
    # stockout at +1, +2, +3 relative to row 0
    assert _label(spark, [0, 1, 0, 0, 0])[0] == 1
    assert _label(spark, [0, 0, 1, 0, 0])[0] == 1
    assert _label(spark, [0, 0, 0, 1, 0])[0] == 0
    # last two rows see past the end as no event
    assert _label(spark, [0, 0, 0, 1, 1])[-2:] == [1, 0]
    assert _label(spark, [0, 0, 1], drop_censored=True) == [1]


def test_label_interleaved_series(spark):
    a = frame(spark, 1, [1] * 4, stockout=[0, 0, 0, 1])
    b = frame(spark, 2, [1] * 4, stockout=[1, 0, 0, 0])
    df = spark.createDataFrame(a + b, SCHEMA)
    got = {(r.facility_id, r.snapshot_date): r.stockout_next_14d for r in labels.next_horizon(df).collect()}
    assert [got[(1, D0 + dt.timedelta(weeks=i))] for i in range(4)] == [0, 1, 1, 0]
    assert [got[(2, D0 + dt.timedelta(weeks=i))] for i in range(4)] == [0, 0, 0, 0]


def test_label_next_days_irregular(spark):
    rows = [(1, "P", D0, 1, 0, 0, 0, 1), (1, "P", D0 + dt.timedelta(days=10), 1, 0, 1, 0, 1),
            (1, "P", D0 + dt.timedelta(days=30), 1, 0, 1, 0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.stockout_next_14d for r in labels.next_days(df).orderBy("snapshot_date").collect()]
    assert got == [1, 0, 0]


LINE = ("facility_id int, product_id string, order_date date, actual_delivery date, quantity_ordered long, "
        "quantity_received long, delay_days long")


def _day(n):
    return D0 + dt.timedelta(days=n)


def test_procurement_lookback_window(spark):
    po = spark.createDataFrame(
        [(1, "P", _day(-1), _day(2), 10, 10, 0), (1, "P", _day(-28), _day(-20), 4, 2, 6),
         (1, "P", _day(-29), _day(-1), 99, 0, 9), (1, "P", _day(0), _day(0), 50, 50, 0)], LINE)
    pan = spark.createDataFrame([(1, "P", D0)], "facility_id int, product_id string, snapshot_date date")
    r = features.procurement_lookback(pan, po).first()
    assert r.po_count_28d == 2 and r.units_ordered_28d == 14
    assert r.avg_fill_rate_28d == pytest.approx((0.5 + 0.0) / 2)
    assert r.avg_delay_28d == 7.5 and r.severe_share_28d == 1.0


def test_lookback_does_not_see_later_deliveries(spark):
    """An order placed in the window and delivered after the snapshot counts as placed, not as an outcome."""
    po = spark.createDataFrame([(1, "P", _day(-3), _day(5), 10, 0, 9)], LINE)
    pan = spark.createDataFrame([(1, "P", D0), (1, "P", _day(7))], "facility_id int, product_id string, snapshot_date date")
    now, later = features.procurement_lookback(pan, po).orderBy("snapshot_date").collect()
    assert (now.po_count_28d, now.avg_delay_28d, now.avg_fill_rate_28d, now.severe_share_28d) == (1, None, None, None)
    assert (later.po_count_28d, later.avg_delay_28d, later.severe_share_28d) == (1, 9.0, 1.0)


@pytest.mark.parametrize("seed", [3, 4])
def test_procurement_lookback_brute_force(spark, seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    orders = []
    for _ in range(150):
        f = int(rng.integers(1, 3))
        n, q = int(rng.integers(0, 90)), int(rng.integers(1, 20))
        orders.append((f, "P", _day(n), _day(n + int(rng.integers(0, 40))), q, int(rng.integers(0, q + 1)), int(rng.integers(0, 12))))
    po = spark.createDataFrame(orders, LINE)
    snaps = [(f, "P", D0 + dt.timedelta(weeks=w)) for f in (1, 2) for w in range(18)]
    pan = spark.createDataFrame(snaps, "facility_id int, product_id string, snapshot_date date")
    got = {(r.facility_id, r.snapshot_date): r for r in features.procurement_lookback(pan, po).collect()}
    for f, _, d in snaps:
        window = lambda day: d - dt.timedelta(days=28) <= day <= d - dt.timedelta(days=1)
        placed = [o for o in orders if o[0] == f and window(o[2])]
        done = [o for o in orders if o[0] == f and window(o[3])]
        r = got[(f, d)]
        assert (r.po_count_28d, r.units_ordered_28d) == (len(placed), sum(o[4] for o in placed))
        if done:
            assert r.avg_fill_rate_28d == pytest.approx(sum(o[5] / o[4] for o in done) / len(done))
            assert r.avg_delay_28d == pytest.approx(sum(o[6] for o in done) / len(done))
            assert r.severe_share_28d == pytest.approx(sum(o[6] >= 5 for o in done) / len(done))
        else:
            assert r.avg_fill_rate_28d is None and r.avg_delay_28d is None
