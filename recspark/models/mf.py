"""Biased explicit matrix factorization."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import clip_rating, damped, dot
from ..operators.candidates import candidate_items
from ..operators.pairs import MAX_LIGHT_HISTORY
from ..operators.stats import biases, history, item_stats, residuals, with_scalars
from .latent import fit_als, rank_by_dot
from .scoring import USER_BLOCK

CANDIDATE_USER_BLOCK = 512


@dataclass
class MatrixFactorization:
    """Global mean + user bias + item bias + inner product, the product fitted to the residuals."""

    mean: DataFrame
    user_bias: DataFrame
    item_bias: DataFrame
    user_factors: DataFrame
    item_factors: DataFrame
    train: DataFrame
    limit: int = MAX_LIGHT_HISTORY

    @classmethod
    def fit(cls, train: DataFrame, n_factors: int = 64, reg: float = 0.1, n_epochs: int = 10,
            seed: int = 42) -> "MatrixFactorization":
        mu, user_bias, item_bias = biases(train)
        u, v = fit_als(residuals(train), "residual", n_factors, reg, n_epochs, seed=seed)
        return cls(mu, user_bias, item_bias, u, v, train)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "mean": self.mean, "user_bias": self.user_bias, "item_bias": self.item_bias,
            "user_factors": self.user_factors, "item_factors": self.item_factors,
            "train": self.train.select("user_id", "item_id", "rating"),
        }

    def params(self) -> dict:
        return {"limit": self.limit}

    @classmethod
    def from_tables(cls, tables, params) -> "MatrixFactorization":
        return cls(**tables, **params)

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Clipped rating; the global mean for an unknown user or item."""
        u = self.user_bias.join(self.user_factors, "user_id").select(
            "user_id", "user_bias", F.col("features").alias("_u")
        )
        i = self.item_bias.join(self.item_factors, "item_id").select(
            "item_id", "item_bias", F.col("features").alias("_i")
        )
        rows = with_scalars(
            pairs.join(u, "user_id", "left").join(i, "item_id", "left"), self.mean
        )
        raw = F.col("global_mean") + F.col("user_bias") + F.col("item_bias") + dot("_u", "_i")
        return rows.withColumn("prediction", clip_rating(raw, F.col("global_mean"))).drop(
            "user_bias", "item_bias", "_u", "_i", "global_mean"
        )

    def candidates(self, users: DataFrame, max_candidates: int = 10000, min_item_ratings: int = 0,
                   exclude: DataFrame | None = None) -> DataFrame:
        return candidate_items(
            users, self.train, max_candidates, min_item_ratings, exclude, self.limit
        )

    def rank(self, users: DataFrame, n: int, exclude: DataFrame | None = None,
             max_candidates: int | None = None, min_item_ratings: int = 0) -> DataFrame:
        """Candidates by inner product over log2(2 + rating count); the score is the plain product.

        Candidates are all unseen items, or ``max_candidates`` per user if that is given.
        """
        counts = item_stats(self.train).select("item_id", "n_ratings")
        damp = damped(F.lit(1.0), F.col("n_ratings"))
        eligible = counts.filter(F.col("n_ratings") >= min_item_ratings)
        scaled = self.item_factors.join(eligible, "item_id").select(
            "item_id", F.transform("features", lambda x: x * damp).alias("features")
        )
        pool, block = None, USER_BLOCK
        if max_candidates is not None:
            pool = self.candidates(users, max_candidates, min_item_ratings, exclude)
            block = CANDIDATE_USER_BLOCK
        ranked = rank_by_dot(
            self.user_factors, scaled, users, n, history(self.train), exclude, "latent_dot",
            pool, block,
        )
        return ranked.join(counts, "item_id").select(
            "user_id",
            "item_id",
            "rank",
            (F.col("score") * F.log2(F.lit(2.0) + F.col("n_ratings"))).alias("score"),
            "score_source",
        )
