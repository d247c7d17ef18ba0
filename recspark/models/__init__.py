"""Rankers and rating models.

A ranker has ``rank(users, n, exclude=None)`` and returns user_id, item_id, rank, score,
score_source. A rating model has ``predict(pairs)`` and returns the pairs with ``prediction``.
"""

from typing import Protocol

from pyspark.sql import DataFrame


class Ranker(Protocol):
    def rank(self, users: DataFrame, n: int, exclude: DataFrame | None = None) -> DataFrame: ...


class RatingModel(Protocol):
    def predict(self, pairs: DataFrame) -> DataFrame: ...


class TextSimilarity(Protocol):
    """Scores (user_id, item_id) pairs with ``text_sim`` in [0, 1]."""

    def score(self, pool: DataFrame) -> DataFrame: ...
