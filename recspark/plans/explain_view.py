"""Ranked, adjusted and explained lists for any set of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.explain import counterfactuals, explain
from ..operators.rerank import adjust_scores
from ..operators.stats import item_popularity
from ..operators.supports import ItemSimilarity
from ..skew import durable


def candidates_to_rank(top_n: int) -> int:
    """List length to rank before adjusting."""
    return max(top_n + 5, 15)


def explain_rankings(
    rankings: DataFrame,
    train: DataFrame,
    index: ItemSimilarity | None = None,
    top_n: int = 10,
    support_weight: float = 0.20,
    popularity_weight: float = 0.10,
    adjust: bool = True,
) -> DataFrame:
    """Explain every ranked item, adjust the lists, and state what would change the final ones.

    ``rankings`` should hold :func:`candidates_to_rank` items per user.
    """
    index = index or ItemSimilarity.fit(train)
    explained = durable(explain(rankings, index))
    lists = rankings
    if adjust:
        lists = durable(
            adjust_scores(
                rankings, explained, item_popularity(train), True, support_weight,
                popularity_weight,
            )
        )
    final = lists.filter(F.col("rank") <= top_n)
    shown = explained.join(
        final.select("user_id", F.col("item_id").alias("recommended_item")),
        ["user_id", "recommended_item"],
        "left_semi",
    )
    reasons = counterfactuals(shown, lists).drop("current_score", "current_rank", "confidence")
    texts = shown.select(
        "user_id", "recommended_item", "explanation_text", "explanation_type",
        F.col("support_confidence").alias("confidence"),
        "supporting_history", "supporting_similar_items",
    )
    return (
        final.withColumnRenamed("item_id", "recommended_item")
        .join(texts, ["user_id", "recommended_item"])
        .join(reasons, ["user_id", "recommended_item"])
        .withColumnRenamed("recommended_item", "item_id")
    )
