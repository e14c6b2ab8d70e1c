"""Loads that add to what is there: star schema, current state, code tables."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from supplyrisk.operators import dictionary, risk, star, state
from supplyrisk.plans import materialize, plan_text
from supplyrisk.sources import testdata as td

from .conftest import SF_SMALL

FACT = "order_id string, line_number int, facility_id int, product_id string, qty bigint, version int, order_month date"


def _month(n):
    return datetime.date(2020, n, 1)


def _rows(df):
    return sorted((tuple(r) for r in df.select("order_id", "line_number", "qty", "version", "order_month").collect()), key=str)


def _set(spark, rows):
    return spark.createDataFrame([(o, n, 1, "p", q, v, m) for o, n, q, v, m in rows], FACT)


SETS = [
    [("a", 1, 10, 1, _month(1)), ("a", 2, 20, 1, _month(1)), ("b", 1, 5, 1, _month(1)), ("b", 1, 5, 1, _month(1))],   # b repeats a line
    [("c", 1, 7, 1, _month(2)), ("d", 1, 8, 1, _month(3))],
    [("a", 1, 11, 2, _month(2)), ("d", 1, 9, 3, _month(3)), ("d", 1, 0, 2, _month(1))],   # a moves month and loses a line; d twice in one set
]
WANT = sorted([("a", 1, 11, 2, _month(2)), ("b", 1, 5, 1, _month(1)), ("b", 1, 5, 1, _month(1)), ("c", 1, 7, 1, _month(2)),
               ("d", 1, 9, 3, _month(3))], key=str)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0), (0, 0, 1, 2, 2), (2, 1, 0, 1, 2, 0)])
def test_any_order_and_repetition_gives_one_table(spark, tmp_path, order):
    path = str(tmp_path / "fact")
    for i in order:
        star.merge_fact(spark, _set(spark, SETS[i]), path, "order_month", ["order_id", "line_number"])
    assert _rows(spark.read.parquet(path)) == WANT


def test_only_the_months_concerned_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "fact")
    merge = lambda rows, **kw: star.merge_fact(spark, _set(spark, rows), path, "order_month", ["order_id"], **kw)
    merge([(f"o{i}", 1, i, 1, _month(1 + i % 6)) for i in range(60)])
    files = lambda m: sorted(f.name for f in (Path(path) / f"order_month={m}").glob("*.parquet"))
    before = {n: files(_month(n)) for n in range(1, 7)}
    assert merge([("o1", 1, 100, 2, _month(2))], key_fixes_month=True) == [_month(2)]
    after = {n: files(_month(n)) for n in range(1, 7)}
    assert [n for n in before if before[n] != after[n]] == [2]
    # an order that moves: its old month is found without being told
    assert merge([("o5", 1, 5, 3, _month(4))]) == [_month(4), _month(6)]
    assert spark.read.parquet(path).where("order_id = 'o5'").select("order_month").collect() == [(_month(4),)]


def test_a_month_that_loses_all_rows_is_emptied(spark, tmp_path):
    path = str(tmp_path / "fact")
    star.merge_fact(spark, _set(spark, [("a", 1, 1, 1, _month(1)), ("b", 1, 1, 1, _month(2))]), path, "order_month", ["order_id"])
    star.merge_fact(spark, _set(spark, [("a", 1, 1, 2, _month(2))]), path, "order_month", ["order_id"])
    assert _rows(spark.read.parquet(path)) == [("a", 1, 1, 2, _month(2)), ("b", 1, 1, 1, _month(2))]


def test_loads_of_the_star_equal_one_load(spark, tmp_path):
    po = materialize(td.purchase_orders(spark, SF_SMALL).withColumn("version", F.lit(1)))
    dims = (td.facilities(spark, SF_SMALL), td.products(spark, SF_SMALL), td.suppliers(spark, SF_SMALL))
    whole = star.build(po, *dims, None, str(tmp_path / "whole"), [t for t in star.TABLES if t != "fact_inventory"])
    for part in (po.where("order_key % 3 = 1"), po.where("order_key % 3 <> 1"), po.where("order_key % 3 = 1")):
        paths = star.load(spark, part, *dims, str(tmp_path / "parts"))
    for t, p in whole.items():
        a, b = spark.read.parquet(p), spark.read.parquet(paths[t]).drop("version")
        assert a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0, t


def test_star_reads_the_order_lines_at_most_twice(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    from supplyrisk.registry import QUERIES
    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(plan_text(self._df, "simple")), write(self, *a, **k))[1])
    QUERIES["star_tables"](spark, SF_SMALL)
    assert sum("l_orderkey" in p and "lineitem.parquet" in p for p in seen) <= 2
    seen.clear()
    QUERIES["star_dims"](spark, SF_SMALL)
    assert sum("lineitem.parquet" in p for p in seen) == 1


def test_bucketed_facts_join_without_a_shuffle(spark):
    from supplyrisk.registry import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(QUERIES["join_po_delivery_bucketed"](spark, SF_SMALL), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text and text.count("Bucketed: true") == 2


def _history(spark):
    rng = random.Random(8)
    start = datetime.date(2020, 1, 6)
    rows = [(f, p, start + datetime.timedelta(days=7 * w), rng.choice([None, rng.randint(0, 9)]), rng.choice([None, rng.random()]),
             rng.choice([None, True, False])) for f in (1, 2) for p in "xyz" for w in range(12)]
    rows.append((3, "x", start, None, None, None))
    return spark.createDataFrame(rows, "facility_id int, product_id string, snapshot_date date, stock int, delay double, flag boolean")


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (0, 0, 2, 1, 3, 1)])
def test_merged_states_equal_the_whole_history(spark, tmp_path, order):
    df = _history(spark)
    parts = [df.where((F.weekofyear("snapshot_date") % 4) == i) for i in range(4)]
    path = str(tmp_path / "state")
    for i in order:
        state.advance(spark, path, parts[i])
    got = state.values(state.read(spark, path)).select(df.columns)
    want = risk.current_state(df).select(df.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 7
    assert len(state.versions(spark, path)) == 2


def test_a_merge_reads_the_state_and_the_new_week_only(spark, tmp_path):
    df = _history(spark)
    path, week = str(tmp_path / "state"), str(tmp_path / "week")
    state.advance(spark, path, df)
    df.where("snapshot_date = '2020-03-23'").write.parquet(week)
    new = state.merged([state.read(spark, path), state.reduced(spark.read.parquet(week))])
    text = plan_text(new, "formatted")
    assert text.count("(1) Scan parquet") == 1 and sum("Location:" in x for x in text.splitlines()) == 2
    (tmp_path / "state" / "00000002").mkdir()   # a merge that did not finish
    assert state.versions(spark, path) == ["00000001"]
    assert state.advance(spark, path, spark.read.parquet(week)) == "00000002"
    with pytest.raises(FileNotFoundError):
        state.read(spark, str(tmp_path / "none"))


def test_codes_keep_their_values(spark, tmp_path):
    path = str(tmp_path / "codes")
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "c string")
    codes = lambda: {r["value"]: r["code"] for r in dictionary.read(spark, path).collect()}
    dictionary.extend(spark, path, frame("m", "b", None, "m", "x"), "c")
    assert codes() == {"b": 0, "m": 1, "x": 2}
    dictionary.extend(spark, path, frame("a", "m", "z", "a"), "c")
    dictionary.extend(spark, path, frame("a", "m", "z", None), "c")
    assert codes() == {"b": 0, "m": 1, "x": 2, "a": 3, "z": 4}
    model = str(tmp_path / "model")
    dictionary.freeze(spark, path, model, "c")
    dictionary.extend(spark, path, frame("new"), "c")
    kept = dictionary.of_model(spark, model, "c")
    rows = dictionary.encode(frame("z", "new", None), kept, "c", "code").collect()
    assert {r["c"]: r["code"] for r in rows} == {"z": 4, "new": dictionary.UNKNOWN, None: None}
    back = dictionary.decode(dictionary.encode(frame("z", "new"), kept, "c", "code"), kept, "code", "again")
    assert {r["c"]: r["again"] for r in back.collect()} == {"z": "z", "new": None}
    dictionary.extend(spark, str(tmp_path / "empty"), frame().limit(0), "c")
    assert dictionary.read(spark, str(tmp_path / "empty")).count() == 0


def test_a_set_without_older_rows_is_added_without_moving_what_is_there(spark, tmp_path):
    path = str(tmp_path / "fact")
    merge = lambda rows: star.merge_fact(spark, _set(spark, rows), path, "order_month", ["order_id"])
    merge([("b", 1, 1, 2, _month(1)), ("a", 1, 1, 1, _month(1)), ("a", 1, 1, 1, _month(1))])
    files = lambda m: {f.name for f in (Path(path) / f"order_month={m}").glob("*.parquet")}
    first = files(_month(1))
    merge([("c", 1, 3, 1, _month(1)), ("b", 1, 9, 1, _month(1))])   # c is new, b is there in a higher version
    assert first < files(_month(1))
    second = files(_month(1))
    merge([("a", 1, 1, 1, _month(1)), ("a", 1, 1, 1, _month(1))])   # a is there with the same rows
    assert files(_month(1)) == second
    merge([("a", 1, 1, 1, _month(1))])   # the same row, once: it replaces both
    assert not files(_month(1)) & second
    assert _rows(spark.read.parquet(path)) == [("a", 1, 1, 1, _month(1)), ("b", 1, 1, 2, _month(1)), ("c", 1, 3, 1, _month(1))]
