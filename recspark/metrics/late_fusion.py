"""Accuracy of text-fused lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.rerank import late_fusion
from .topn import accuracy_summary, evaluation_users, list_metrics


def evaluate_late_fusion(
    pool: DataFrame,
    text_profiles,
    train: DataFrame,
    test: DataFrame,
    alpha: float,
    *,
    top_n: int = 10,
    pool_size: int = 80,
    min_train_ratings: int = 5,
    relevance_threshold: float | None = 4.0,
) -> DataFrame:
    """Like ``evaluate_recommendations`` on fused lists; users without a pool are not counted.

    ``pool`` holds rankings of at least ``max(pool_size, top_n)`` items per user.
    """
    size = max(int(pool_size), int(top_n))
    users = evaluation_users(train, test, min_train_ratings, relevance_threshold)
    own = pool.filter(F.col("rank") <= size).join(users.select("user_id"), "user_id", "left_semi")
    fused = late_fusion(own, text_profiles.score(own), alpha)
    with_pool = users.join(own.select("user_id").distinct(), "user_id", "left_semi")
    summary = accuracy_summary(
        list_metrics(fused, with_pool, test, top_n, relevance_threshold)
    )
    return summary.withColumn("alpha", F.lit(float(alpha))).withColumn("pool_size", F.lit(size))
