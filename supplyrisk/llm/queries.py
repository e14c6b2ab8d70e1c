"""Query bindings of the operators, one ``opN_<name>`` per operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyrisk.llm import (centroids, chat, decontam, extract_html, hard_negatives, kd_shards, ngram_join, packing, pii,
                            quality, secret_scan, suffix_dedup, token_files)
from supplyrisk.plans import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html.extract(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                        public_tokenizers.path("word_bpe_49k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "token-files"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                         _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = chat.format_conversations(rows.unionByName(extra))
    read = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.integer_vectors(_table(spark, sf_dir, "embeddings"), scale=64, dims=64)
    return centroids.report(vectors, k=16, rounds=3, seed=1)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(_table(spark, sf_dir, "documents"), shards=40)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.labelled_vectors(_table(spark, sf_dir, "embeddings"), scale=256, label=moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, percent=80)


QUERIES = {
    "op1_html": op1_html, "op2_packing": op2_packing, "op3_pii": op3_pii, "op4_ngram_join": op4_ngram_join,
    "op5_secrets": op5_secrets, "op6_quality": op6_quality, "op7_token_files": op7_token_files,
    "op8_decontam": op8_decontam, "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat": op10_chat, "op11_centroids": op11_centroids, "op12_sharding": op12_sharding,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {}
