"""Gradient-boosted stockout model on Spark ML.

``train`` fits ``VectorAssembler -> GBTClassifier`` (or the Spark ML
classifier given as ``estimator``) with class-balancing row weights;
``score`` adds the positive-class probability.  The
training frame is written once (``materialize``) because boosting scans
it once per tree level; ``checkpointInterval`` with the shared checkpoint
folder keeps the lineage of the boosting state short.  A level is a job, and
its tasks follow the rows (``ROWS_PER_TASK``), not the files of the frame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from supplyrisk.operators.dataset import FEATURES, TARGET
from supplyrisk.operators.evaluate import class_weights
from supplyrisk.plans import files
from supplyrisk.plans.materialize import materialize, scratch
from supplyrisk.session import checkpoint_dir

# Estimator settings of the source pipeline.
GB_PARAMS = {"maxIter": 400, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8,
             "minInstancesPerNode": 10, "seed": 42}
DECISION_THRESHOLD = 0.30

#: Rows of a training task: about 0.1 s of work, several times the cost of starting it.
ROWS_PER_TASK = 200_000

_DONE = "_STORED"   # marks a complete model folder


def numeric_features(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Booleans become 0/1 doubles; all features double."""
    return df.withColumns({c: F.col(c).cast("int").cast("double") if dict(df.dtypes)[c] == "boolean"
                           else F.col(c).cast("double") for c in features})


def train(df: DataFrame, features: Sequence[str] = FEATURES, label: str = TARGET,
          weight_col: str | None = "weight", checkpoint_interval: int = 10, estimator=None,
          rows_per_task: int = ROWS_PER_TASK, **params) -> PipelineModel:
    """Fit the pipeline; missing feature values raise (impute first).

    ``estimator`` swaps the classifier: any Spark ML classifier that yields
    a probability; its column params are set here, the others are its own.
    ``rows_per_task`` bounds the tasks of each boosting step: training a
    small table costs more in task starts than in work.
    """
    p = {**GB_PARAMS, **params}
    checkpoint_dir(df.sparkSession)
    data = numeric_features(df, features).withColumn(label, F.col(label).cast("double"))
    if weight_col:
        data = class_weights(data, label, weight_col)
    seen = Observation()
    data = materialize(data.select(*features, label, *([weight_col] if weight_col else []))
                           .observe(seen, F.count(F.lit(1)).alias("n")))
    data = data.coalesce(max(1, -(-seen.get["n"] // rows_per_task)))
    if estimator is None:
        # a walk down four levels costs less than a cached table of node ids per level; the trees are the same
        est = GBTClassifier(checkpointInterval=checkpoint_interval, cacheNodeIds=False, **p)
    else:
        est = estimator.copy()
    est.set(est.featuresCol, "features")
    est.set(est.labelCol, label)
    if weight_col and est.hasParam("weightCol"):
        est.set(est.weightCol, weight_col)
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[asm, est]).fit(data)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES,
          out: str = "risk_score") -> DataFrame:
    """Positive-class probability as ``out``; input columns keep their types."""
    keep = df.columns
    pred = model.transform(_with_numeric(df, features))
    return pred.select(*[F.col(f"__orig_{c}").alias(c) if c in features else F.col(c) for c in keep],
                       vector_to_array("probability")[1].alias(out))


def _with_numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Keep original feature columns under ``__orig_*`` next to their double casts."""
    return numeric_features(df.withColumns({f"__orig_{c}": F.col(c) for c in features}), features)


def predict(score_col: str = "risk_score", threshold: float = DECISION_THRESHOLD) -> Column:
    """``score >= threshold`` as 0/1 (not the library's ratio thresholds)."""
    return (F.col(score_col) >= F.lit(threshold)).cast("int")


def save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """Feature importances (one row per feature, a fixed count), ascending."""
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return (spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
                 .orderBy("importance", "feature"))


def stored(spark: SparkSession, path: str) -> bool:
    """Is a complete model stored at ``path``?"""
    return files.exists(spark, f"{path}/{_DONE}")


def store(spark: SparkSession, model: PipelineModel, path: str) -> str:
    """Save aside, then rename: a reader never meets half a model, and of two runs saving one path the first stays."""
    aside = save(model, f"{path}.{uuid.uuid4().hex}")
    files.mark(spark, f"{aside}/{_DONE}")
    if not files.rename(spark, aside, path):
        files.delete(spark, aside)
    return path


def stored_or_trained(spark: SparkSession, path: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The model at ``path``; trained by ``fit`` and stored there when it is not."""
    if not stored(spark, path):
        store(spark, fit(), path)
    return load(path)


def cross_validate(df: DataFrame, fold: Column, k: int = 5, features: Sequence[str] = FEATURES, label: str = TARGET,
                   threshold: float = DECISION_THRESHOLD, fit: Callable[[int, DataFrame], PipelineModel] | None = None,
                   parallel: int | None = None, **params) -> DataFrame:
    """One model per fold, trained on the other folds: (fold, train_rows, test_rows, tn, fp, fn, tp, recall).

    ``fold`` must map rows to 0..k-1 deterministically (e.g. by series, so
    a series never sits on both sides); rows of another or no fold raise.
    The table is written once, one folder per fold, so a fold's training
    reads the other folders only.  The folds are independent jobs and run
    ``parallel`` at a time (all by default): while one waits for its driver,
    another uses the executors.  ``fit(fold, training_rows)`` replaces the
    training, e.g. by one that stores its models.  A fold without rows has
    no row in the result; one without positives has a null recall.
    """
    spark = df.sparkSession
    path = scratch(spark, "folds")
    known = F.col("_fold").isNotNull() & F.col("_fold").between(0, k - 1)
    tagged = df.withColumn("_fold", fold.cast("int"))
    tagged.withColumn("_fold", F.when(known, F.col("_fold")).otherwise(
        F.raise_error(F.lit(f"a row's fold is not in 0..{k - 1}")).cast("int"))).write.partitionBy("_fold").parquet(path)
    data = spark.read.schema(tagged.schema).parquet(path)
    sizes = {r["_fold"]: r["n"] for r in data.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).collect()}   # k rows
    fit = fit or (lambda f, rows: train(rows, features, label, **params))

    def one(f: int) -> PipelineModel:
        return fit(f, data.where(F.col("_fold") != f))

    with ThreadPoolExecutor(parallel or k) as pool:
        models = dict(zip(sizes, pool.map(inheritable_thread_target(spark)(one), sizes)))
    out = None
    for f, m in models.items():
        test = score(m, data.where(F.col("_fold") == f).select(*features, label), features)
        y, hit = F.col(label).cast("int") == 1, F.col("risk_score") >= F.lit(threshold)
        row = test.agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"),
                       F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp"))
        row = row.select(F.lit(f).alias("fold"), F.lit(sum(sizes.values()) - sizes[f]).cast("bigint").alias("train_rows"), "*",
                         (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))
        out = row if out is None else out.unionAll(row)
    if out is None:
        return spark.createDataFrame([], "fold int, train_rows bigint, test_rows bigint, tn bigint, fp bigint, fn bigint, "
                                         "tp bigint, recall double")
    return out


def cross_validate_recall(df: DataFrame, fold: Column, k: int = 5, features: Sequence[str] = FEATURES,
                          label: str = TARGET, threshold: float = DECISION_THRESHOLD, **params) -> DataFrame:
    """Mean and sample standard deviation of the folds' recall (``cross_validate``).  One row."""
    per = cross_validate(df, fold, k, features, label, threshold, **params)
    return per.agg(F.avg("recall").alias("mean_recall"), F.stddev_samp("recall").alias("std_recall"),
                   F.count(F.lit(1)).alias("n_folds"))
