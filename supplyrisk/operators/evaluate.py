"""Classifier evaluation as aggregate plans over a scored table.

Everything starts from the *score table*: one row per distinct score with
its positive/negative counts (a grouped aggregate with map-side partial
counts), then running true/false-positive counts in descending score
order (two-level prefix sums, ``functions.stats``).  Curves, AUC,
average precision and threshold tuning are projections of that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.functions.stats import prefix_sums
from supplyrisk.plans.materialize import materialize


def _i(c: str) -> Column:
    return F.col(c).cast("int")


def score_table(df: DataFrame, label: str = "stockout_next_14d", score: str = "risk_score",
                buckets: int | None = None, next_values: bool = False) -> DataFrame:
    """score, pos, neg, tp, fp (counts at threshold >= score), idx (0 = top); with ``next_values`` also the
    counts of the next lower score."""
    st = (df.groupBy(F.col(score).alias("score"))
            .agg(F.sum(_i(label)).cast("bigint").alias("pos"),
                 F.sum(F.lit(1) - _i(label)).cast("bigint").alias("neg")))
    out = prefix_sums(st, "score", ["pos", "neg"], descending=True, buckets=buckets, next_values=next_values)
    return out.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")


def auc(df: DataFrame, label: str = "stockout_next_14d", score: str = "risk_score") -> DataFrame:
    """ROC-AUC by the rank-sum rule (tied scores count one half). One row.

    Numerator and denominator stay integers (doubled), so the value is
    exact: ``sum(pos*(2*neg_below + neg_tied)) / (2*P*N)``.
    """
    st = materialize(score_table(df, label, score))
    P = st.select(F.max("tp")).scalar()
    N = st.select(F.max("fp")).scalar()
    # negatives strictly below this score = N - fp (fp counts scores >= it)
    num = F.sum(F.col("pos") * (F.lit(2) * (N - F.col("fp")) + F.col("neg")))
    return st.agg((num.cast("double") / (F.lit(2.0) * P * N)).alias("roc_auc"),
                  P.alias("positives"), N.alias("negatives"))


def average_precision(df: DataFrame, label: str = "stockout_next_14d", score: str = "risk_score",
                      digits: int | None = 10) -> DataFrame:
    """Step-wise AP: ``sum over thresholds of (R_k - R_{k-1}) * P_k`` (no interpolation)."""
    st = materialize(score_table(df, label, score))
    P = st.select(F.max("tp")).scalar()
    ap = F.sum(F.col("pos").cast("double") / P * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    out = st.agg(ap.alias("_ap"))
    if digits is not None:
        return out.select((F.floor(F.col("_ap") * F.lit(10.0 ** digits) + F.lit(0.5)) / F.lit(10.0 ** digits)).alias("average_precision"))
    return out.select(F.col("_ap").alias("average_precision"))


def confusion(df: DataFrame, label: str = "stockout_next_14d", score: str = "risk_score",
              threshold: float = 0.30) -> DataFrame:
    """Dense 2x2 matrix as 4 rows (actual, predicted, n); ``pred = score >= t``."""
    pred = (F.col(score) >= F.lit(threshold))
    y = _i(label) == 1
    one = df.agg(F.count_if(~y & ~pred).alias("tn"), F.count_if(~y & pred).alias("fp"),
                 F.count_if(y & ~pred).alias("fn"), F.count_if(y & pred).alias("tp"))
    return one.select(F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)"))


def report(df: DataFrame, label: str = "stockout_next_14d", score: str = "risk_score",
           threshold: float = 0.30, digits: int | None = 10) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted avg.

    A zero denominator gives 0 (the source library's default).
    """
    pred = (F.col(score) >= F.lit(threshold))
    y = _i(label) == 1
    c = df.agg(F.count_if(~y & ~pred).alias("tn"), F.count_if(~y & pred).alias("fp"),
               F.count_if(y & ~pred).alias("fn"), F.count_if(y & pred).alias("tp"))

    def ratio(a, b):
        return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))

    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = ratio(tp, tp + fp), ratio(tp, tp + fn)
    p0, r0 = ratio(tn, tn + fn), ratio(tn, tn + fp)
    m = c.select(
        p0.alias("p0"), r0.alias("r0"), (tn + fp).alias("s0"),
        p1.alias("p1"), r1.alias("r1"), (tp + fn).alias("s1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("acc"), (tp + tn + fp + fn).alias("n"))
    f = lambda p, r: F.coalesce(F.lit(2.0) * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    m = m.withColumns({"f0": f(F.col("p0"), F.col("r0")), "f1": f(F.col("p1"), F.col("r1"))})
    rows = m.select(F.expr("""stack(5,
        '0', p0, r0, f0, s0,
        '1', p1, r1, f1, s1,
        'accuracy', acc, acc, acc, n,
        'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n,
        'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n)
        AS (class, precision, recall, f1_score, support)"""))
    if digits is None:
        return rows
    rnd = lambda c_: (F.floor(F.col(c_) * F.lit(10.0 ** digits) + F.lit(0.5)) / F.lit(10.0 ** digits)).alias(c_)
    return rows.select("class", rnd("precision"), rnd("recall"), rnd("f1_score"), "support")


def roc_points(df: DataFrame, label: str = "stockout_next_14d", score: str = "risk_score",
               drop_intermediate: bool = True) -> DataFrame:
    """ROC curve: (fpr, tpr, threshold), starting at (0, 0, +inf).

    With ``drop_intermediate`` a point is kept when the curve bends there
    (non-zero second difference in fp or tp) or it is the first or last.
    """
    st = materialize(score_table(df, label, score, next_values=drop_intermediate))   # four branches read it
    P = st.select(F.max("tp")).scalar()
    N = st.select(F.max("fp")).scalar()
    kept = st
    if drop_intermediate:
        # steps before and after a point: its own counts and the next score's
        bend = (F.col("next_neg") != F.col("neg")) | (F.col("next_pos") != F.col("pos"))
        kept = st.where((F.col("idx") == 0) | F.col("next_pos").isNull() | bend)
    pts = kept.select(F.col("fp").alias("fpc"), F.col("tp").alias("tpc"), F.col("score").alias("threshold"))
    # the (0, 0, +inf) start point: a one-row aggregate of constants
    start = st.agg(F.max(F.lit(0).cast("bigint")).alias("fpc"), F.max(F.lit(0).cast("bigint")).alias("tpc"),
                   F.max(F.lit(float("inf"))).alias("threshold"))
    return pts.unionByName(start).select((F.col("fpc") / N).alias("fpr"), (F.col("tpc") / P).alias("tpr"),
                                         "threshold")


def pr_points(df: DataFrame, label: str = "stockout_next_14d", score: str = "risk_score") -> DataFrame:
    """Precision-recall curve: points from the top score down to the first
    threshold reaching full recall, plus the final (precision 1, recall 0)."""
    st = materialize(score_table(df, label, score))
    P = st.select(F.max("tp")).scalar()
    first_full = st.where(F.col("tp") == P).select(F.min("idx")).scalar()
    pts = st.where(F.col("idx") <= first_full).select(
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / P).alias("recall"),
        F.col("score").alias("threshold"))
    # the final (precision 1, recall 0) point: a one-row aggregate of constants
    end = st.agg(F.max(F.lit(1.0)).alias("precision"), F.max(F.lit(0.0)).alias("recall"),
                 F.max(F.lit(None).cast("double")).alias("threshold"))
    return pts.unionByName(end)


def tune_threshold(df: DataFrame, label: str = "stockout_next_14d", score: str = "risk_score",
                   min_precision_pct: int = 60) -> DataFrame:
    """Threshold with the highest recall among those with precision >= the
    bound (ties: higher precision, then higher threshold).  Integer test
    ``tp*100 >= pct*(tp+fp)``.  One row."""
    st = materialize(score_table(df, label, score))
    P = st.select(F.max("tp")).scalar()
    ok = st.where(F.col("tp") * F.lit(100) >= F.lit(min_precision_pct) * (F.col("tp") + F.col("fp")))
    key = F.struct(F.col("tp"), (F.col("tp") / (F.col("tp") + F.col("fp"))), F.col("score"))
    best = ok.agg(F.max_by(F.struct("score", "tp", "fp"), key).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), F.col("b.tp").alias("tp"),
                       (F.col("b.tp") + F.col("b.fp")).alias("predicted"),
                       P.alias("positives"),
                       (F.col("b.tp") / (F.col("b.tp") + F.col("b.fp"))).alias("precision"),
                       (F.col("b.tp") / P).alias("recall"))


def cv_recall(df: DataFrame, fold: Column, label: str = "stockout_next_14d", score: str = "risk_score",
              threshold: float = 0.30, digits: int = 6) -> DataFrame:
    """Recall per fold at the threshold, then mean and sample std across folds."""
    y = _i(label) == 1
    pred = F.col(score) >= F.lit(threshold)
    per = (df.withColumn("_fold", fold).groupBy("_fold")
             .agg((F.count_if(y & pred) / F.nullif(F.count_if(y), F.lit(0))).alias("_r")))
    out = per.agg(F.avg("_r").alias("m"), F.stddev_samp("_r").alias("s"), F.count(F.lit(1)).alias("n_folds"))
    k = float(10 ** digits)
    return out.select((F.floor(F.col("m") * k + 0.5) / k).alias("mean_recall"),
                      (F.floor(F.col("s") * k + 0.5) / k).alias("std_recall"), "n_folds")


def class_balance(df: DataFrame, label: str = "stockout_next_14d") -> DataFrame:
    """Counts per class, negative/positive weight and positive rate. One row."""
    y = _i(label)
    return (df.agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"),
                   F.avg(y).alias("positive_rate"))
              .withColumn("pos_weight", F.col("n_neg") / F.nullif(F.col("n_pos"), F.lit(0))))


def class_weights(df: DataFrame, label: str = "stockout_next_14d", out: str = "weight") -> DataFrame:
    """Row weight: neg/pos for positives, 1.0 otherwise (scalar subquery)."""
    y = _i(label)
    w = df.select(F.count_if(y == 0) / F.nullif(F.count_if(y == 1), F.lit(0))).scalar()
    return df.withColumn(out, F.when(y == 1, w).otherwise(F.lit(1.0)))


# ---- user-facing names -------------------------------------------
ap = average_precision
roc = roc_points
pr = pr_points
tune = tune_threshold
