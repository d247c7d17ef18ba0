"""Popularity baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.stats import global_mean, history, item_stats, popularity_order, with_scalars
from ..operators.topk import first_free_positions, union_exclusions


@dataclass
class Popularity:
    order: DataFrame  # item_id, n_ratings, sum_rating, avg_rating, pos
    mean: DataFrame  # global_mean
    seen: DataFrame  # user_id, item_id

    @classmethod
    def fit(cls, train: DataFrame) -> "Popularity":
        return cls(popularity_order(item_stats(train)), global_mean(train), history(train))

    def tables(self) -> dict[str, DataFrame]:
        return {"order": self.order, "mean": self.mean, "seen": self.seen}

    def params(self) -> dict:
        return {}

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame], params: dict) -> "Popularity":
        return cls(tables["order"], tables["mean"], tables["seen"])

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Item mean, or the global mean for an unknown item."""
        means = self.order.select("item_id", "avg_rating")
        joined = with_scalars(pairs.join(means, "item_id", "left"), self.mean)
        return joined.withColumn(
            "prediction", F.coalesce("avg_rating", "global_mean")
        ).drop("avg_rating", "global_mean")

    def rank(self, users: DataFrame, n: int, exclude: DataFrame | None = None) -> DataFrame:
        """Most rated unseen items; an unknown user gets the global list."""
        taken = union_exclusions(self.seen, exclude).join(
            self.order.select("item_id", "pos"), "item_id"
        )
        wanted = users.select("user_id").distinct().withColumn("need", F.lit(n))
        free = first_free_positions(wanted, taken, "need")
        # Users share few positions, so this joins a short prefix of the catalogue.
        return free.join(self.order.select("pos", "item_id", "n_ratings"), "pos").select(
            "user_id",
            "item_id",
            "rank",
            F.col("n_ratings").cast("double").alias("score"),
            F.lit("item_counts").alias("score_source"),
        )

    def popular_items(self, n: int = 20) -> DataFrame:
        return self.order.orderBy("pos").limit(n).select(
            "item_id", "avg_rating", F.col("n_ratings").alias("num_ratings")
        )
