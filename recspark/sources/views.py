"""Interaction and review views over star-schema Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..skew import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """Order lines as ratings: customer rates part; quantity 1-50 becomes 1-5 stars."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    # Orders grow with the lines and take far less room in their file than in memory.
    joined = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.md5(
        F.concat_ws(
            "|",
            F.lit(seed),
            "o_custkey",
            "l_partkey",
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        )
    )
    return joined.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
        key.alias("row_key"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews: ten documents per item, a reviewer for each twenty, first line as the
    summary. Reviewers are dealt over blocks of 400 documents, so they grow with the table and each
    meets most items of its block."""
    docs = spread(
        table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    )
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(quality, "doc_id", "left").select(
        (F.floor(F.col("doc_id") / 400) * 20 + F.col("doc_id") % 20).cast("long")
        .alias("user_id"),
        F.floor(F.col("doc_id") / 10).cast("long").alias("item_id"),
        (F.lit(1) + F.col("n_chars") % 5).cast("double").alias("rating"),
        F.substring_index("text", "\n", 1).alias("summary"),
        F.col("text").alias("reviewText"),
        F.when(F.col("quality") == 1, F.lit("true"))
        .when(F.col("quality") == 0, F.lit("false"))
        .alias("verified"),
        F.create_map(
            F.lit("Lang:"), F.col("lang"), F.lit("Source:"), F.col("source")
        ).alias("style"),
        F.col("doc_id").alias("row_key"),
    )


def item_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_partkey").alias("ingest_order"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embedding table split into user vectors (even ids) and item vectors (odd ids)."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return emb.filter(F.col("id") % 2 == 0), emb.filter(F.col("id") % 2 == 1)
