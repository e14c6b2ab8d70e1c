import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from supplyrisk.operators import panel

D0 = dt.date(2024, 1, 1)


def _flows(spark, series):
    rows = []
    for key, flows in series.items():
        for i, (r, c) in enumerate(flows):
            rows.append((key, "P", D0 + dt.timedelta(weeks=i), r, c))
    return spark.createDataFrame(rows, "facility_id int, product_id string, snapshot_date date, received long, consumption long")


def _loop(opening, flows):
    out, prev = [], opening
    for r, c in flows:
        close = max(0, prev + r - c)
        out.append((prev, close))
        prev = close
    return out


def _run(spark, series, opening):
    df = panel.roll_forward(_flows(spark, series), ["facility_id", "product_id"], F.lit(opening))
    got = {}
    for row in df.orderBy("facility_id", "snapshot_date").collect():
        got.setdefault(row.facility_id, []).append((row.opening_stock, row.closing_stock))
    return got


def test_floor_twice_never_and_one_row(spark):
    series = {
        1: [(0, 30), (50, 10), (0, 100), (5, 0), (0, 20), (40, 0)],   # hits zero twice
        2: [(10, 5), (10, 5), (10, 5)],                                 # never floors
        3: [(3, 50)],                                                   # one row
    }
    got = _run(spark, series, 20)
    for k, flows in series.items():
        assert got[k] == _loop(20, flows), k


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=12),
       st.integers(0, 30))
def test_closed_form_matches_loop(spark, flows, opening):
    assert _run(spark, {7: flows}, opening)[7] == _loop(opening, flows)


def test_dense_calendar_fills_gaps(spark):
    rows = [(1, "A", D0, 5, 0, 1), (1, "A", D0 + dt.timedelta(weeks=3), 2, 0, 1),
            (2, "B", D0 + dt.timedelta(weeks=1), 0, 4, 0)]
    flows = spark.createDataFrame(rows, "facility_id int, product_id string, week date, received long, consumption long, n_orders long")
    dense = panel.dense_calendar(flows, ["facility_id", "product_id"])
    got = sorted((r.facility_id, r.snapshot_date, r.received, r.consumption) for r in dense.collect())
    assert len(got) == 8  # 2 series x 4 weeks
    assert (1, D0 + dt.timedelta(weeks=1), 0, 0) in got
    assert (2, D0 + dt.timedelta(weeks=1), 0, 4) in got


def test_calendar_bounds_and_reconciliation(spark):
    """Consumption after the last order week stays outside the order calendar, counted; all_weeks keeps it."""
    import datetime as dt

    from supplyrisk.operators import panel
    rows = [(1, "A", dt.date(2024, 1, 1), 10, 4, 1), (1, "A", dt.date(2024, 1, 15), 5, 4, 1), (1, "A", dt.date(2024, 1, 29), 0, 7, 0)]
    flows = spark.createDataFrame(rows, "facility_id int, product_id string, week date, received long, consumption long, n_orders long")
    keys = ["facility_id", "product_id"]
    rec = {r.flow: (r.total, r.inside, r.outside) for r in panel.reconciliation(flows).collect()}
    assert rec == {"received": (15, 15, 0), "consumption": (15, 8, 7)}
    kept = panel.dense_calendar(flows, keys).agg({"consumption": "sum", "*": "count"}).first()
    assert tuple(kept) == (8, 3)
    every = panel.dense_calendar(flows, keys, bounds=panel.all_weeks(flows)).agg({"consumption": "sum", "*": "count"}).first()
    assert tuple(every) == (15, 5)
    assert {r.outside for r in panel.reconciliation(flows, bounds=panel.all_weeks(flows)).collect()} == {0}


def test_split_by_any_fraction(spark):
    import datetime as dt

    from supplyrisk.operators import split
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(1000)], "snapshot_date date")
    for fraction, want in ((0.8, 799), (0.875, 874), (0.995, 994), (0.999, 998), (0.5, 499)):
        train, test = split.by_fraction(df, fraction)
        assert (train.count(), test.count()) == (want, 1000 - want)
