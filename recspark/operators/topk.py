"""Ranking lists: numbering, cutting and seen-item exclusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..skew import dealt

# Scores are compared after rounding, so the order of a distributed sum cannot reorder a list.
SCORE_DIGITS = 9


def top_k(df: DataFrame, keys: str | list[str], order: list[Column], k: int | None,
          rank_col: str = "rank") -> DataFrame:
    """Number rows per key and keep the first ``k`` (pruned before the shuffle by the planner)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank_col) <= k)


def rank_by_score(scored: DataFrame, n: int, score: str = "score",
                  source: str | None = None) -> DataFrame:
    """Rankings from (user, item, score): best score first, ties by item id."""
    rounded = scored.withColumn(score, F.round(score, SCORE_DIGITS))
    ranked = top_k(rounded, "user_id", [F.col(score).desc_nulls_last(), F.col("item_id")], n)
    return ranked.select(
        "user_id",
        "item_id",
        "rank",
        F.col(score).cast("double").alias("score"),
        F.lit(source).cast("string").alias("score_source"),
    )


def recommend(rankings: DataFrame, top_n: int) -> DataFrame:
    """The first ``top_n`` of each list."""
    return rankings.filter(F.col("rank") <= top_n)


def ranking_lists(rankings: DataFrame) -> DataFrame:
    """One row per user with the ordered list (lists are short by construction)."""
    entry = F.struct("rank", "item_id", "score")
    return rankings.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))


def union_exclusions(*parts: DataFrame | None) -> DataFrame:
    """Distinct (user, item) of all exclusion sources."""
    frames = [p.select("user_id", "item_id") for p in parts if p is not None]
    return reduce(DataFrame.unionByName, frames).distinct()


def without(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop (user, item) rows found in ``seen``; the composite key keeps hot users spread out."""
    return df.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def first_free_positions(users: DataFrame, taken: DataFrame, need: str, block: int = 1024) -> DataFrame:
    """First positions 1, 2, 3, … of an ordered catalogue that a user has not taken.

    ``users`` holds ``user_id`` and the wanted number ``need``; ``taken`` holds distinct
    (user_id, pos). With p_i the i-th taken position of a user, exactly the taken positions with
    ``p_i - i < need`` lie before the last wanted free one, so positions up to ``need`` plus their
    number hold the answer. No user is paired with the catalogue. Taken positions are numbered per
    block of the catalogue, so a user who took most of it is still spread out. Both compress to a few
    bytes a row, so their sorts are dealt to a number of tasks (see :func:`~recspark.skew.dealt`).
    """
    mine = dealt(taken.select("user_id", "pos"), "user_id").join(users.select("user_id", need), "user_id")
    mine = mine.withColumn("_blk", F.floor((F.col("pos") - 1) / block))
    sizes = mine.groupBy("user_id", "_blk").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select(
        "user_id",
        "_blk",
        (F.sum("_rows").over(W.partitionBy("user_id").orderBy("_blk")) - F.col("_rows"))
        .alias("_offset"),
    )
    local = F.row_number().over(W.partitionBy("user_id", "_blk").orderBy("pos"))
    skipped = (
        mine.withColumn("_i", local)
        .join(offsets, ["user_id", "_blk"])
        .filter(F.col("pos") - (F.col("_i") + F.col("_offset")) < F.col(need))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("_skipped"))
    )
    last = F.col(need) + F.coalesce("_skipped", F.lit(0))
    blocks = (
        users.select("user_id", need)
        .filter(F.col(need) > 0)
        .join(skipped, "user_id", "left")
        .select(
            "user_id",
            last.alias("_last"),
            F.explode(F.sequence(F.lit(0), F.floor((last - 1) / block).cast("int"))).alias("_b"),
        )
    )
    open_positions = dealt(blocks, "user_id", "_b").select(
        "user_id",
        F.explode(
            F.sequence(
                (F.col("_b") * block + 1).cast("long"),
                F.least((F.col("_b") + 1) * block, F.col("_last")).cast("long"),
            )
        ).alias("pos"),
    )
    free = open_positions.join(
        dealt(taken.select("user_id", F.col("pos").cast("long").alias("pos")), "user_id", "pos"),
        ["user_id", "pos"], "left_anti",
    )
    w = W.partitionBy("user_id").orderBy("pos")
    return dealt(free, "user_id").withColumn("rank", F.row_number().over(w))
