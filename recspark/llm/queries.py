"""Registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import divergence, exact_dedup, hard_negatives, huffman, licenses, mixing, near_dedup, \
    packing, quality, secrets, sharding, topk_search, toxicity
from .common import table


def _digest(df: DataFrame) -> DataFrame:
    """``df`` with the unsigned crc32 of its ids in place of the ids."""
    return df.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else F.col(c)
                       for c in df.columns])


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.document_licenses(spark, d)


def op3_huffman(spark: SparkSession, d: str) -> DataFrame:
    return huffman.roundtrip(table(spark, d, "documents"), derive=_digest)


def op4_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, d, "documents"))


def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_pieces(table(spark, d, "documents"))


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_sharding(spark: SparkSession, d: str) -> DataFrame:
    placed = sharding.shard(table(spark, d, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, d, "documents"))


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk_search.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, d, "embeddings").withColumn("label", moved))


def op12_divergence(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audit(table(spark, d, "documents"))


def op13_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_licenses, op3_huffman, op4_ngram_jaccard, op5_packing, op6_quality, op7_sharding,
    op8_exact_dedup, op9_mixing, op10_topk, op11_hard_negatives, op12_divergence, op13_secrets)}
