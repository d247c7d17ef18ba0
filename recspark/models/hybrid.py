"""Content hybrid: a base ranker's pool reordered by text similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.rerank import history_alpha, late_fusion
from ..operators.stats import history, history_sizes
from ..skew import durable
from . import Ranker, TextSimilarity
from .popularity import Popularity


@dataclass
class ContentHybrid:
    base: Ranker
    text: TextSimilarity
    train: DataFrame
    enabled: bool = True
    alpha: float = 0.70
    cold_alpha: float = 0.35
    pool_size: int = 80
    cold_threshold: int = 5

    def rank(self, users: DataFrame, n: int, exclude: DataFrame | None = None) -> DataFrame:
        """Fused lists; users the base ranker has no pool for get popular unseen items.

        Fused scores are not model scores, so ``score`` is NULL and ``fused`` holds the blend.
        """
        if not self.enabled:
            return self.base.rank(users, n, exclude)
        users = users.select("user_id").distinct()
        sizes = history_sizes(history(self.train))
        known = users.join(sizes, "user_id", "left_semi")
        # Read by the fusion, the text scores and the fallback; pool_size rows per user.
        pool = durable(self.base.rank(known, max(self.pool_size, n), exclude))
        weights = history_alpha(
            pool.select("user_id").distinct(), sizes, self.alpha, self.cold_alpha,
            self.cold_threshold,
        )
        weighted = pool.join(weights, "user_id")
        fused = late_fusion(weighted, self.text.score(pool), F.col("alpha")).filter(
            F.col("rank") <= n
        )
        rest = users.join(pool.select("user_id").distinct(), "user_id", "left_anti")
        fallback = Popularity.fit(self.train).rank(rest, n, exclude)
        score = F.lit(None).cast("double")
        source = F.lit(None).cast("string")
        return fused.select(
            "user_id", "item_id", "rank", score.alias("score"), source.alias("score_source"),
            "fused",
        ).unionByName(
            fallback.select(
                "user_id", "item_id", "rank", score.alias("score"),
                source.alias("score_source"), F.lit(None).cast("double").alias("fused"),
            )
        )
