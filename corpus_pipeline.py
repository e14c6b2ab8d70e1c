"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything its
predecessor kept; ``run`` writes each result as Parquet under the shared
checkpoint folder and rereads it as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from supplyrisk.llm import decontam, ngram_join, packing, quality, secret_scan
from supplyrisk.plans import materialize

STAGES = [
    ("quality_rules", quality.quality_stage),
    ("near_duplicates", ngram_join.dedup_stage),
    ("benchmark_decontamination", decontam.decontaminate_stage),
    ("secret_scans", secret_scan.secret_stage),
    ("best_fit_packing", packing.packing_stage),
]

#: Tokenizing and packing have no SQL form; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name=f"stage-{name}")
    return docs
