"""Shared parts of factor models: id columns, ALS fitting, ranking."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from ..operators.split import id_index
from ..operators.topk import rank_by_score, union_exclusions
from ..skew import checkpoint_dir, durable
from .scoring import USER_BLOCK, top_items


# Ratings of a block of users or items, whose other side a task of the fit holds; ten blocks at least.
BLOCK_RATINGS = 3_000_000


def coded(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train rows with integer ids, and the two id tables."""
    users = id_index(train, "user_id", "user_idx")
    items = id_index(train, "item_id", "item_idx")
    return train.join(users, "user_id").join(items, "item_id"), users, items


def fit_als(train: DataFrame, value: str, rank: int, reg: float, iterations: int,
            implicit: bool = False, alpha: float = 1.0, seed: int = 42):
    """User and item factors by id: (user_id, features), (item_id, features).

    Every iteration is checkpointed: that cuts its lineage, so the shuffle files of an iteration, each
    some copies of all factors, go when the next one is done instead of piling up to the end. Blocks are
    as many as the ratings need, since a task holds the factors that its block of the other side names.
    """
    sc = train.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(train.sparkSession))
    rows, users, items = coded(train)
    rows = durable(rows.select(
        F.col("user_idx").cast("int"), F.col("item_idx").cast("int"), F.col(value).cast("float")))
    blocks = max(10, -(-rows.count() // BLOCK_RATINGS))
    als = ALS(
        rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=implicit, alpha=alpha,
        userCol="user_idx", itemCol="item_idx", ratingCol=value, seed=seed,
        coldStartStrategy="nan", checkpointInterval=1, numUserBlocks=blocks, numItemBlocks=blocks,
    )
    model = als.fit(rows)
    u = model.userFactors.join(
        users.select(F.col("user_idx").alias("id"), "user_id"), "id"
    ).select("user_id", "features")
    i = model.itemFactors.join(
        items.select(F.col("item_idx").alias("id"), "item_id"), "id"
    ).select("item_id", "features")
    return durable(u), durable(i)


def rank_by_dot(
    user_factors: DataFrame, item_factors: DataFrame, users: DataFrame, n: int, seen: DataFrame,
    exclude: DataFrame | None, source: str, candidates: DataFrame | None = None,
    user_block: int = USER_BLOCK,
) -> DataFrame:
    """Rankings by inner product; users without factors have no list."""
    wanted = user_factors.join(users.select("user_id").distinct(), "user_id", "left_semi")
    taken = union_exclusions(seen, exclude).join(
        users.select("user_id").distinct(), "user_id", "left_semi"
    )
    best = top_items(wanted, item_factors, n, taken, candidates, user_block)
    return rank_by_score(best, n, source=source)
