import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyrisk.operators import validate
from supplyrisk.sources import ingest, sinks

PO_SCHEMA = "order_id string, quantity_ordered long, quantity_received long, delay_days long"


def test_rules_report_and_assert(spark):
    po = spark.createDataFrame([
        ("A", 10, 10, 0), ("B", 0, 0, 0), ("C", None, 1, 0), ("D", 10, 11, 2), ("E", 5, 2, -1)], PO_SCHEMA)
    rep = {r.rule: r.violations for r in validate.po_rules(po).collect()}
    assert rep["quantity_ordered_positive"] == 2          # 0 and NULL
    assert rep["fill_rate_in_unit_interval"] == 3         # 0/0, NULL and 1.1
    assert rep["delay_days_non_negative"] == 1
    with pytest.raises(validate.ValidationError, match="quantity_ordered_positive"):
        validate.assert_valid(validate.po_rules(po))
    ok = spark.createDataFrame([("A", 10, 10, 0)], PO_SCHEMA)
    assert validate.assert_valid(validate.po_rules(ok)).count() == 4


def test_orphan_po(spark):
    proc = spark.createDataFrame([("A",), ("B",)], "order_id string")
    deliv = spark.createDataFrame([("A",), ("Z",)], "order_id string")
    assert [r.order_id for r in validate.orphans(deliv, proc, "order_id").collect()] == ["Z"]
    r = validate.ri_rule(deliv, proc, "order_id", "order_id", "delivery -> po").first()
    assert (r.violations, r.checked, r.example_key) == (1, 2, "Z")


def test_bad_dates(spark):
    df = spark.createDataFrame([("2024-13-01",), ("2024-02-30",), ("2024-2-3",), (None,)], "d string")
    r = validate.date_rule(df, "d").first()
    assert (r.violations, r.checked) == (2, 4)
    typed = ingest.typed(df, {"d": T.DateType()}).collect()
    assert [x.d for x in typed] == [None, None, dt.date(2024, 2, 3), None]
    assert [x.cast_errors for x in typed] == [1, 1, 0, 0]


def test_profile_long_form(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = {(r.column_name, r.n_rows, r.n_nulls) for r in ingest.profile(df, "src").collect()}
    assert got == {("a", 2, 0), ("b", 2, 1)}


def test_csv_roundtrip_with_dates(spark, tmp_path):
    df = spark.createDataFrame([("ORD-000001", dt.date(2024, 1, 2), 3)], "order_id string, order_date date, q long")
    p = sinks.write_csv(df, str(tmp_path / "csv"))
    back = ingest.read_csv(spark, p, T.StructType.fromJson(json.loads(df.schema.json())))
    assert back.collect() == df.collect()


def _csv(tmp_path, text, name="x.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


QTY = T.StructType([T.StructField("order_id", T.StringType()), T.StructField("ordered", T.LongType()),
                    T.StructField("received", T.LongType())])


def test_csv_columns_go_by_name(spark, tmp_path):
    for text in ("order_id,ordered,received\nA,40,7\n", "received,order_id,ordered\n7,A,40\n",
                 "note,received,order_id,more,ordered\nx,7,A,y,40\n"):
        assert ingest.read_csv(spark, _csv(tmp_path, text), QTY).collect() == [("A", 40, 7)]
    with pytest.raises(ValueError, match="received"):
        ingest.read_csv(spark, _csv(tmp_path, "order_id,ordered\nA,40\n"), QTY)
    t = ingest.read_text_csv(spark, _csv(tmp_path, "b,a\n1,2\n"), ["a", "b"]).first()
    assert (t.a, t.b) == ("2", "1")


def test_csv_corrupt_lines_are_kept(spark, tmp_path):
    df = ingest.read_csv(spark, _csv(tmp_path, "order_id,ordered,received\nA,x,7\nB,1,2\n"), QTY, corrupt_column="raw")
    assert {r.order_id: r.raw for r in df.cache().collect()} == {"A": "A,x,7", "B": None}


def test_orders_export_layout(spark, tmp_path):
    text = ("order_id,facility_id,facility_name,region,facility_beds,product_id,product_name,category,critical_item,"
            "unit_cost,supplier_id,supplier_name,supplier_reliability,order_date,expected_delivery,actual_delivery,"
            "quantity_ordered,quantity_received,lead_days_planned,delay_days,fulfilled,unit_cost_total\n"
            "ORD-000001,F001,General,Northeast,450,P001,Gloves,PPE,True,12.5,S01,Supply Co,0.97,2023-01-02,2023-01-05,"
            "2023-01-05,40,40,3,0,True,500.0\n")
    r = ingest.read_csv(spark, _csv(tmp_path, text), ingest.ORDERS_SCHEMA).first()
    assert (r.facility_id, r.facility_beds, r.supplier_id, r.order_date, r.quantity_received, r.fulfilled) == \
        ("F001", 450, "S01", dt.date(2023, 1, 2), 40, True)


def test_json_output_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(sinks.json_records(df).first().record) == {"a": 1, "b": None}
    cols = "total_alerts long, facility_id int, product_id string, risk_score double, note string"
    rows = [(9, i % 3, f"P{i}", (i * 7 % 10) / 10, None) for i in range(9)]
    env = json.loads(sinks.alerts_envelope(spark.createDataFrame(rows, cols).repartition(4), limit=5).first().record)
    want = sorted(rows, key=lambda r: (-r[3], r[1], r[2]))[:5]
    assert env["total_alerts"] == 9
    assert [(a["facility_id"], a["product_id"], a["risk_score"], a["note"]) for a in env["alerts"]] == [r[1:] for r in want]
    assert json.loads(sinks.alerts_envelope(spark.createDataFrame([], cols)).first().record) == {"total_alerts": 0, "alerts": []}


def test_scores_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", 0.5)], "facility_id int, product_id string, risk_score double")
    assert spark.read.schema(df.schema).json(sinks.write_scores(df, str(tmp_path / "s"))).collect() == df.collect()


def test_metadata_document_source_layout(spark, tmp_path):
    doc = {"facilities": {"F001": {"name": "General", "beds": 450, "region": "Northeast"}},
           "suppliers": {"S01": {"name": "Supply Co", "reliability": 0.97, "avg_lead_days": 3.0}},
           "products": {"P001": {"name": "Gloves", "category": "PPE", "unit_cost": 12.5, "critical": True}},
           "date_range": {"start": "2023-01-02", "end": "2024-12-30"}}
    path = tmp_path / "metadata.json"
    path.write_text(json.dumps(doc, indent=2))
    dims = ingest.read_metadata_document(spark, str(path))
    f = dims["facilities"].first()
    assert (f.facility_id, f.facility_name, f.facility_beds, f.region) == ("F001", "General", 450, "Northeast")
    assert dims["products"].first().critical_item is True
    assert dims["date_range"].first().end == dt.date(2024, 12, 30)


def test_metadata_json_lines_roundtrip(spark, tmp_path):
    fac = spark.createDataFrame([(1, "N1", "R", 160)], "facility_id int, facility_name string, region string, facility_beds long")
    sup = spark.createDataFrame([(5, "S5", 0.75, 6.0)], "supplier_id long, supplier_name string, reliability double, avg_lead_days double")
    prod = spark.createDataFrame([("SMALL", "Small", "SIZE", 1.5, True)],
                                 "product_id string, product_name string, category string, unit_cost double, critical_item boolean")
    p = sinks.write_metadata(fac, sup, prod, F.lit(dt.date(2020, 1, 6)), F.lit(dt.date(2021, 1, 4)), str(tmp_path / "m"))
    dims = ingest.metadata_dimensions(ingest.read_metadata(spark, p))
    assert dims["suppliers"].first().reliability == 0.75
    assert dims["date_range"].first().start == dt.date(2020, 1, 6)


def test_user_facing_names_exist():
    from supplyrisk.operators import evaluate, features, panel, report, risk, validate
    from supplyrisk.sources import ingest as ing
    for mod, names in [(risk, ["train", "score", "current", "level"]),
                       (evaluate, ["auc", "ap", "roc", "pr", "confusion", "report", "tune"]),
                       (features, ["rolling", "lags", "procurement", "calendar", "supplier"]),
                       (report, ["facilities", "risk", "alerts", "supplier_delays", "stat_strip"]),
                       (validate, ["report", "assert_valid"]), (panel, ["build", "roll_forward"]),
                       (ing, ["read_table"])]:
        for n in names:
            assert callable(getattr(mod, n)), (mod.__name__, n)


def test_panel_build_one_call(spark):
    rows = [(1, "A", dt.date(2024, 1, 1), 10, 4, 1), (1, "A", dt.date(2024, 1, 15), 0, 4, 1)]
    flows = spark.createDataFrame(rows, "facility_id int, product_id string, week date, received long, consumption long, n_orders long")
    from supplyrisk.operators import panel
    inv = panel.build(flows, ["facility_id", "product_id"], F.lit(1), 2, F.lit(True))
    got = [(r.opening_stock, r.closing_stock) for r in inv.orderBy("snapshot_date").collect()]
    # mean consumption (4+0+4)/3: opening floor(8/3)=2; 2+10-4=8; 8-0=8; 8-4=4
    assert got == [(2, 8), (8, 8), (8, 4)]
