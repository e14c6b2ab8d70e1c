import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplyrisk.functions.scalar import risk_level
from supplyrisk.operators import evaluate, risk

D0 = dt.date(2024, 1, 1)


def test_risk_bands_right_closed(spark):
    scores = [0.0, 0.25, 0.2501, 0.55, 0.5501, 1.0, 1.2, -0.001]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r.lv for r in df.select("s", risk_level("s").alias("lv")).collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "High", "High", None, None]


def test_current_state_last_non_null_per_column(spark):
    rows = [(1, "P", D0, 5, 1.0), (1, "P", D0 + dt.timedelta(weeks=1), 6, 2.0),
            (1, "P", D0 + dt.timedelta(weeks=2), 7, None)]
    df = spark.createDataFrame(rows, "facility_id int, product_id string, snapshot_date date, closing_stock long, avg_delay_days double")
    r = risk.current_state(df).first()
    assert r.snapshot_date == D0 + dt.timedelta(weeks=2)
    assert r.closing_stock == 7
    assert r.avg_delay_days == 2.0   # last non-NULL, not the last row


def scored(spark, labels_, scores):
    return spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels_, scores)],
                                 "stockout_next_14d int, risk_score double")


def rank_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("y,s", [
    ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]),
    ([0, 1, 0, 1, 1, 0], [0.5, 0.5, 0.2, 0.9, 0.5, 0.9]),      # ties
    ([0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4]),                      # perfect
    ([0, 0, 1, 1], [0.4, 0.3, 0.2, 0.1]),                      # inverted
])
def test_auc_rank_sum(spark, y, s):
    got = evaluate.auc(scored(spark, y, s)).first().roc_auc
    assert got == pytest.approx(rank_auc(y, s))


def test_auc_invariant_under_monotone_transform(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200), 2)
    a = evaluate.auc(scored(spark, y, s)).first().roc_auc
    b = evaluate.auc(scored(spark, y, s ** 3)).first().roc_auc
    assert a == pytest.approx(b)


def ap_stepwise(y, s):
    order = np.argsort(-np.asarray(s), kind="stable")
    y, s = np.asarray(y)[order], np.asarray(s)[order]
    P, ap, tp, fp = y.sum(), 0.0, 0, 0
    for th in sorted(set(s), reverse=True):
        m = s == th
        tp += y[m].sum()
        fp += (1 - y[m]).sum()
        ap += y[m].sum() / P * tp / (tp + fp)
    return ap


def test_average_precision_stepwise(spark):
    y = [0, 1, 0, 1, 1, 0, 1]
    s = [0.1, 0.9, 0.4, 0.4, 0.8, 0.7, 0.2]
    got = evaluate.average_precision(scored(spark, y, s), digits=None).first().average_precision
    assert got == pytest.approx(ap_stepwise(y, s))


def test_confusion_cells_sum_and_missing_class(spark):
    df = scored(spark, [0, 0, 0], [0.1, 0.5, 0.9])
    cells = {(r.actual, r.predicted): r.n for r in evaluate.confusion(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 2, (1, 0): 0, (1, 1): 0}
    rep = {r["class"]: r for r in evaluate.report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].support == 0


def test_roc_points_drop_collinear(spark):
    # scores desc 0.9(1) 0.8(1) 0.7(0) 0.6(0) 0.5(1)
    df = scored(spark, [1, 1, 0, 0, 1], [0.9, 0.8, 0.7, 0.6, 0.5])
    pts = sorted((r.fpr, r.tpr, r.threshold) for r in evaluate.roc_points(df).collect())
    # first and last thresholds are always kept; (0.5, 2/3) at 0.7 lies on the
    # straight segment from (0, 2/3) to (1, 2/3) and is dropped
    assert pts == sorted([(0.0, 0.0, float("inf")), (0.0, 1 / 3, 0.9), (0.0, 2 / 3, 0.8),
                          (1.0, 2 / 3, 0.6), (1.0, 1.0, 0.5)])


def test_pr_points_and_tuning(spark):
    df = scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    pts = [(r.recall, r.precision, r.threshold) for r in evaluate.pr_points(df).collect()]
    assert set(pts) == {(0.5, 1.0, 0.9), (0.5, 0.5, 0.8), (1.0, 2 / 3, 0.7), (0.0, 1.0, None)}
    # stops at the first threshold with full recall: 0.1 is dropped
    best = evaluate.tune_threshold(df, min_precision_pct=60).first()
    assert best.threshold == 0.7 and best.tp == 2 and best.predicted == 3


def test_cv_recall_and_class_weights(spark):
    df = spark.createDataFrame([(i % 2, 1, 0.9 if i % 3 else 0.1) for i in range(12)],
                               "f int, stockout_next_14d int, risk_score double")
    r = evaluate.cv_recall(df, F.col("f")).first()
    assert r.n_folds == 2 and 0 <= r.mean_recall <= 1
    w = evaluate.class_weights(scored(spark, [1, 0, 0, 0], [0.1] * 4)).collect()
    assert sorted(x.weight for x in w) == [1.0, 1.0, 1.0, 3.0]


def _curves(y, s):
    """Both curves from their definition, one threshold at a time."""
    y, s = [int(v) for v in y], [float(v) for v in s]
    P, N = sum(y), len(y) - sum(y)
    points = []   # (fp, tp, threshold) from the highest threshold down
    for t in sorted(set(s), reverse=True):
        points.append((sum(1 - a for a, b in zip(y, s) if b >= t), sum(a for a, b in zip(y, s) if b >= t), t))
    roc = {(0.0, 0.0, float("inf"))}
    for i, (f, t, h) in enumerate(points):
        straight = 0 < i < len(points) - 1 and all(
            points[i + 1][k] - points[i][k] == points[i][k] - points[i - 1][k] for k in (0, 1))
        if not straight:
            roc.add((f / N, t / P, h))
    pr = {(1.0, 0.0, None)}
    for f, t, h in points:
        pr.add((t / (t + f), t / P, h))
        if t == P:
            break
    return roc, pr


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_curves_match_reference_algorithm(spark, seed):
    rng = np.random.default_rng(seed)
    n = 120
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)   # many ties
    df = scored(spark, y, s)
    roc, pr = _curves(y, s)
    got_roc = {(r.fpr, r.tpr, r.threshold) for r in evaluate.roc_points(df).collect()}
    got_pr = {(r.precision, r.recall, r.threshold) for r in evaluate.pr_points(df).collect()}
    rnd = lambda t: tuple(round(v, 12) if isinstance(v, float) and v != float("inf") else v for v in t)
    assert {rnd(t) for t in got_roc} == {rnd(tuple(float(x) if x is not None else None for x in t)) for t in roc}
    assert {rnd(t) for t in got_pr} == {rnd(tuple(float(x) if x is not None else None for x in t)) for t in pr}
