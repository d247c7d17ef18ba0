"""Counts, means and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..skew import global_position, packed, unpacked


def item_stats(train: DataFrame) -> DataFrame:
    """Rows, rating sum and mean rating per item."""
    return train.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.sum("rating").alias("sum_rating"),
        F.avg("rating").alias("avg_rating"),
    )


def global_mean(train: DataFrame) -> DataFrame:
    """Mean rating, one row."""
    return train.agg(F.avg("rating").alias("global_mean"))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of an aggregate without keys (exactly one row).

    The row travels as one struct-valued scalar subquery, so it is computed once for all columns.
    """
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("s"))
    out = df.withColumn("_scalars", packed.scalar())
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col("_scalars").getField(c).alias(c) for c in one_row.columns],
    )


def history(train: DataFrame) -> DataFrame:
    """Distinct (user, item)."""
    return train.select("user_id", "item_id").distinct()


def history_sizes(hist: DataFrame) -> DataFrame:
    return hist.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_train"))


def rater_counts(hist: DataFrame) -> DataFrame:
    """Distinct raters per item."""
    return hist.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_raters"))


def item_popularity(train: DataFrame) -> DataFrame:
    """Rating count per item and the count relative to the most rated item."""
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ratings"))
    top = counts.agg(F.max("n_ratings").alias("_max"))
    return with_scalars(counts, top).select(
        "item_id", "n_ratings", (F.col("n_ratings") / F.col("_max")).alias("popularity")
    )


def popularity_order(stats: DataFrame) -> DataFrame:
    """Item statistics with ``pos``: 1 for the most rated item, ties by item id."""
    return global_position(stats, [F.col("n_ratings").desc(), F.col("item_id")], "pos")


def biases(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Global mean, and user and item means relative to it."""
    mu = global_mean(train)
    user = with_scalars(train.groupBy("user_id").agg(F.avg("rating").alias("m")), mu)
    item = with_scalars(train.groupBy("item_id").agg(F.avg("rating").alias("m")), mu)
    return (
        mu,
        user.select("user_id", (F.col("m") - F.col("global_mean")).alias("user_bias")),
        item.select("item_id", (F.col("m") - F.col("global_mean")).alias("item_bias")),
    )


def residuals(train: DataFrame) -> DataFrame:
    """Rating minus global mean, user bias and item bias.

    All rows move twice, once for each bias, with their digests packed.
    """
    mu, user, item = biases(train)
    keys = ("user_id", "item_id")
    texts = [n for n, t in train.dtypes if t == "string" and n not in keys]
    joined = with_scalars(packed(train, *texts).join(item, "item_id").join(user, "user_id"), mu)
    return unpacked(joined, *texts).withColumn(
        "residual",
        F.col("rating") - F.col("global_mean") - F.col("user_bias") - F.col("item_bias"),
    )


def dataset_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Users, items, interactions and the share of empty user-item cells, one row."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    counts = df.agg(
        distinct("user_id").alias("n_users"),
        distinct("item_id").alias("n_items"),
        F.count(F.lit(1)).alias("n_interactions"),
    )
    cells = F.col("n_users").cast("double") * F.col("n_items")
    return counts.withColumn(
        "sparsity",
        F.when(cells > 0, F.lit(1.0) - F.col("n_interactions") / cells).otherwise(F.lit(0.0)),
    )


def user_profiles(train: DataFrame, top: int = 15) -> DataFrame:
    """Items rated, mean rating and the best-rated items of each user."""
    totals = train.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rated"), F.avg("rating").alias("avg_rating")
    )
    w = W.partitionBy("user_id").orderBy(
        F.col("rating").desc(), F.col("item_id"), F.col("row_key")
    )
    best = (
        train.withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= top)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "item_id", "rating"))).alias("best"))
    )
    return totals.join(best, "user_id").select(
        "user_id",
        "n_rated",
        "avg_rating",
        F.transform("best", lambda b: F.struct(b["item_id"], b["rating"])).alias("best_rated"),
    )
