import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplyrisk.operators import model as gbm
from supplyrisk.plans import exchanges, has_python_udf, materialize, plan_text
from supplyrisk.sources import testdata as td

from .conftest import SF_SMALL


def test_panel_plan_one_key_exchange_no_udf(spark):
    inv = td.inventory_panel(spark, SF_SMALL)
    assert not has_python_udf(inv)
    # every window and the final sum of the panel reuse one hash exchange on the series keys
    on_keys = [e for e in exchanges(inv) if re.match(r"Exchange hashpartitioning\(facility_id#\d+, product_id#\d+, \d+\), REPARTITION", e)]
    assert len(on_keys) == 1
    lines = plan_text(inv, "simple").splitlines()
    for i, line in enumerate(lines):
        if "Window" in line:
            assert "SinglePartition" not in " ".join(lines[i:i + 4])


def test_pushdown_and_pruning_reach_scan(spark):
    po = td.lines(spark, SF_SMALL).where(F.col("line_status") == "F").select("supplier_id", "delay_days")
    txt = plan_text(po, "formatted")
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in txt
    assert "l_tax" not in txt and "l_extendedprice" not in txt


@pytest.mark.parametrize("key, scans", [
    ("validate_rules", {"lineitem"}), ("proj_order_id", {"lineitem"}), ("proj_partial_receipt", {"lineitem"}),
    ("proj_delay_severity", {"lineitem"}), ("supplier_delays", {"lineitem", "supplier"}),
    ("proj_delivery_dates", {"lineitem", "orders"}), ("feat_calendar", {"lineitem", "orders"}),
    ("proj_seasonal", {"lineitem", "orders"}), ("distinct_dates", {"lineitem", "orders"}),
    ("proj_line_cost", {"lineitem", "part"}), ("supplier_facility_alerts", {"lineitem", "orders", "customer"})])
def test_line_queries_scan_what_they_use(spark, key, scans):
    import __spark_entry__ as E
    txt = plan_text(E.queries()[key](spark, SF_SMALL), "simple")
    assert set(re.findall(r"sf0\.001/(\w+)\.parquet", txt)) == scans
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", txt)) == len(scans) - 1


def test_registered_keys_have_no_python_udf(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for k in ["supplier_delays", "inv_rollforward", "feat_procurement_28d", "facility_summary"]:
        assert not has_python_udf(qs[k](spark, SF_SMALL)), k


def _separable(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.random(n)
    rows = [(float(v), float(1 - v), int(v > 0.6), bool(v > 0.3)) for v in x]
    return spark.createDataFrame(rows, "closing_stock double, days_of_supply double, stockout_next_14d int, critical_item boolean")


def test_model_beats_base_rate_and_save_load(spark, tmp_path):
    feats = ["closing_stock", "days_of_supply", "critical_item"]
    df = _separable(spark)
    m = gbm.train(df, feats, maxIter=5)
    scored = gbm.score(m, df, feats)
    acc = scored.select(F.avg((gbm.predict() == F.col("stockout_next_14d")).cast("int"))).first()[0]
    base = max(df.select(F.avg("stockout_next_14d")).first()[0], 1 - df.select(F.avg("stockout_next_14d")).first()[0])
    assert acc > base
    p = gbm.save(m, str(tmp_path / "model"))
    again = gbm.score(gbm.load(p), df, feats)
    a = [r.risk_score for r in scored.orderBy("closing_stock").collect()]
    b = [r.risk_score for r in again.orderBy("closing_stock").collect()]
    assert a == pytest.approx(b)
    imp = gbm.importances(m, feats).collect()
    assert len(imp) == 3 and imp[-1].feature in ("closing_stock", "days_of_supply")
    assert dict(scored.dtypes)["critical_item"] == "boolean"


AUDIT_KEYS = ["supplier_delays", "inv_rollforward", "feat_procurement_28d", "label_reorder_14d",
              "risk_current", "alerts", "category_stockout_rate", "eval_roc_points", "eval_tune_threshold",
              "validate_ri", "encode_labels", "split_80_20"]


def test_no_unscalable_nodes_in_key_plans(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for k in AUDIT_KEYS:
        txt = plan_text(qs[k](spark, SF_SMALL), "simple")
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in txt, (k, bad)
        # a window fed by a single-partition exchange must sit on an aggregate
        # (bounded input: distinct dates, bucket totals), never on raw rows
        lines = txt.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line and i > 0 and "Window" in "".join(lines[max(0, i - 3):i]):
                below = " ".join(lines[i + 1:i + 3])
                assert "HashAggregate" in below or "Aggregate" in below, (k, below)


def test_tasks_of_a_training_follow_its_rows(spark, monkeypatch):
    feats = ["closing_stock", "days_of_supply", "critical_item"]
    df = materialize(_separable(spark, 200).repartition(8))
    seen = []
    monkeypatch.setattr(gbm.Pipeline, "fit", lambda self, data: seen.append((data.count(), data.rdd.getNumPartitions())))
    gbm.train(df, feats)
    gbm.train(df, feats, rows_per_task=100)
    gbm.train(df, feats, rows_per_task=1)   # never more than the frame has
    assert seen[:2] == [(200, 1), (200, 2)] and seen[2][0] == 200 and 1 < seen[2][1] <= 8


def test_cross_validation_trains_one_model_per_fold(spark):
    feats = ["closing_stock", "days_of_supply", "critical_item"]
    df = _separable(spark, 200).withColumn("k", (F.monotonically_increasing_id() % 3).cast("int"))
    seen = []

    def fit(f, rows):
        seen.append((f, rows.select("k").distinct().collect()))
        return gbm.train(rows, feats, maxIter=3, rows_per_task=1000)
    per = {r["fold"]: r for r in gbm.cross_validate(df, F.col("k"), k=3, features=feats, fit=fit).collect()}
    assert sorted(f for f, _ in seen) == [0, 1, 2] == sorted(per)
    assert all(f not in [r["k"] for r in ks] and len(ks) == 2 for f, ks in seen)
    size = {r["k"]: (r["n"], r["p"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("stockout_next_14d").alias("p")).collect()}
    for f, r in per.items():
        assert r.test_rows == size[f][0] == r.tn + r.fp + r.fn + r.tp and r.fn + r.tp == size[f][1]
        assert r.train_rows == 200 - size[f][0] and r.recall == r.tp / (r.tp + r.fn)
    one = gbm.cross_validate_recall(df, F.col("k"), k=3, features=feats, maxIter=3, parallel=1).first()
    assert one.n_folds == 3 and 0.0 <= one.mean_recall <= 1.0
    with pytest.raises(Exception, match="not in 0..1"):
        gbm.cross_validate(df, F.col("k"), k=2, features=feats, maxIter=1)
    assert gbm.cross_validate(df.limit(0), F.col("k"), k=3, features=feats).count() == 0


def test_models_are_stored_once(spark, tmp_path):
    from supplyrisk.plans import files
    feats = ["closing_stock", "days_of_supply", "critical_item"]
    df, path, fits = _separable(spark, 100), str(tmp_path / "m"), []

    def fit():
        fits.append(1)
        return gbm.train(df, feats, maxIter=2)
    files.mark(spark, str(tmp_path / "m.left-over" / "x"))   # a save that never ended is not a model
    a, b = gbm.stored_or_trained(spark, path, fit), gbm.stored_or_trained(spark, path, fit)
    assert len(fits) == 1 and gbm.stored(spark, path) and not gbm.stored(spark, str(tmp_path / "m.left-over"))
    rows = lambda m: [r.risk_score for r in gbm.score(m, df, feats).orderBy("closing_stock").collect()]
    assert rows(a) == rows(b)
    gbm.store(spark, a, path)   # the first model stays
    assert [f for f in files.children(spark, str(tmp_path)) if f.startswith("m.")] == ["m.left-over"]


def test_another_estimator(spark):
    from pyspark.ml.classification import LogisticRegression
    from supplyrisk.operators import risk
    feats = ["closing_stock", "days_of_supply", "critical_item"]
    df = _separable(spark, 200)
    m = risk.train(df, features=feats, estimator=LogisticRegression(maxIter=20))
    scored = risk.score(m, df, features=feats)
    acc = scored.select(F.avg((gbm.predict(threshold=0.5) == F.col("stockout_next_14d")).cast("int"))).first()[0]
    assert acc > 0.9


def test_intermediates_are_deleted(spark):
    from pathlib import Path
    from supplyrisk.plans import intermediates, materialize
    from supplyrisk.session import checkpoint_dir
    folder = Path(checkpoint_dir(spark))
    before = set(folder.iterdir())
    with intermediates(spark):
        assert materialize(spark.range(5)).count() == 5
        assert len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before
    for _ in range(3):
        checkpoint_dir(spark)
    assert set(folder.iterdir()) == before


def test_unset_checkpoint_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace
    from supplyrisk.session import checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))


def test_joins_of_the_order_lines_move_no_derived_columns(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(td.purchase_orders(spark, SF_SMALL), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = text[text.index("Exchange"):]
    assert "l_orderkey" in below and not any(x in below for x in ("order_id", "AS delay_days", "AS quantity_received"))
