"""Candidate items of a user: items co-rated with the history, filled up with popular ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..skew import durable, ranked_in_group
from .pairs import MAX_LIGHT_HISTORY, light_pairs, split_history
from .stats import history, item_stats, popularity_order
from .topk import first_free_positions, top_k, union_exclusions, without

POSITION_BLOCK = 100_000
# Items of every list that are read at first, of as many candidates or fewer as eight times that.
FIRST_PLACES = 64


def _along_lists(steps: DataFrame, short: DataFrame, max_candidates: int, deepest: int) -> DataFrame:
    """Distinct (user_id, pos) in the lists (``short``: anchor, pos; ``deepest`` at most) of a user's
    anchors (``steps``: user_id, anchor, n_taken), the first ``max_candidates + n_taken`` of each user.

    Lists are read from the front, four times as far for users who need it. Up to the least position at
    which one of a user's lists was cut, all positions are known; a user is done when they are enough.
    Positions travel as one array per list.
    """
    lists = durable(short.groupBy("anchor").agg(F.sort_array(F.collect_list("pos")).alias("all")))
    wanted = F.lit(max_candidates) + F.col("n_taken")
    left, parts, places = steps, [], max(FIRST_PLACES, max_candidates // 8)
    while True:
        cut = lists.select("anchor", F.slice("all", 1, places).alias("own"), F.when(
            F.size("all") > places, F.get("all", F.lit(places - 1))).alias("end"))
        rows = left.join(cut, "anchor").groupBy("user_id", "n_taken").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("own")))).alias("own"),
            F.min("end").alias("end"))
        known = F.when(F.col("end").isNull(), F.col("own")).otherwise(
            F.filter("own", lambda x: x <= F.col("end")))
        rows = rows.withColumn("own", known).withColumn(
            "done", F.col("end").isNull() | (F.size("own") >= wanted))
        rows = durable(rows.select("user_id", "done", F.when(
            F.col("done"), F.slice("own", F.lit(1), wanted.cast("int"))).alias("own")))
        parts.append(rows.filter("done").select("user_id", F.explode("own").alias("pos")))
        rest = rows.filter(~F.col("done")).select("user_id")
        if places >= deepest or not rest.take(1):
            return reduce(DataFrame.unionByName, parts)
        left, places = left.join(rest, "user_id", "left_semi"), places * 4


def co_rated_candidates(
    users: DataFrame, hist: DataFrame, order: DataFrame, max_candidates: int,
    limit: int = MAX_LIGHT_HISTORY, taken: DataFrame | None = None,
) -> DataFrame:
    """Distinct (user_id, item_id, pos): items reached from a user's history through any rater.

    Only the ``max_candidates`` most popular items that a user has not ``taken`` (history and
    exclusions; default: history) are wanted in the end. With n taken ones, of every list reached
    only the first ``max_candidates + n`` by popularity can matter. Lists of light raters come from their item
    pairs; a heavy rater is reached as a whole (user -> heavy rater -> its items) and its items are
    never paired.
    """
    h = split_history(hist, limit)
    taken = hist if taken is None else taken
    sizes = taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_taken"))
    mine = hist.join(users.select("user_id"), "user_id", "left_semi")
    pos = order.select("item_id", "pos")
    pairs = light_pairs(h.light)
    both = F.array(
        F.struct(F.col("item_a").alias("anchor"), F.col("item_b").alias("item_id")),
        F.struct(F.col("item_b").alias("anchor"), F.col("item_a").alias("item_id")),
    )
    edges = pairs.select(F.inline(both)).join(pos, "item_id")
    asked = sizes.join(mine.select("user_id").distinct(), "user_id", "left_semi")
    if h.heavy is not None:
        asked = asked.join(h.heavy.select("user_id").distinct(), "user_id", "left_anti")
    most = asked.agg(F.max("n_taken").alias("n")).first()["n"] or 0
    deepest = max_candidates + most
    short = top_k(edges, "anchor", [F.col("pos")], deepest, "place").select("anchor", "pos")

    def along(part: DataFrame) -> DataFrame:
        steps = part.join(sizes, "user_id").withColumnRenamed("item_id", "anchor")
        return _along_lists(steps, short, max_candidates, deepest).join(pos, "pos").select(
            "user_id", "item_id", "pos")

    if h.heavy is None:
        return along(mine)

    heavy_users = h.heavy.select("user_id").distinct()
    busy = mine.join(heavy_users, "user_id", "left_semi").withColumnRenamed("item_id", "anchor")
    found = along(mine.join(heavy_users, "user_id", "left_anti")).unionByName(
        busy.join(edges, "anchor").select("user_id", "item_id", "pos"))
    owner = h.heavy.select(F.col("user_id").alias("owner"), "item_id")
    met = mine.join(owner, "item_id").select("user_id", "owner").distinct().join(sizes, "user_id")
    owned = ranked_in_group(
        owner.join(pos, "item_id"),
        "owner",
        order=[F.col("pos")],
        bucket=F.floor(F.col("pos") / POSITION_BLOCK),
        rank_col="place",
    )
    through = met.join(owned, "owner").filter(
        F.col("place") <= max_candidates + F.col("n_taken")
    )
    return found.unionByName(through.select("user_id", "item_id", "pos")).distinct()


def candidate_items(
    users: DataFrame,
    train: DataFrame,
    max_candidates: int = 10000,
    min_item_ratings: int = 0,
    exclude: DataFrame | None = None,
    limit: int = MAX_LIGHT_HISTORY,
) -> DataFrame:
    """Candidates per user: co-rated unseen items first (most popular kept), popular items after.

    Output: user_id, item_id, cand_rank, source ('cooccurrence' or 'popular').
    """
    hist = history(train)
    stats = item_stats(train).filter(F.col("n_ratings") >= min_item_ratings)
    order = durable(popularity_order(stats))
    n_items = order.count()
    taken = union_exclusions(hist, exclude)
    found = without(
        co_rated_candidates(users, hist, order, max_candidates, limit, taken), taken
    )
    # Read three times below; at most max_candidates rows per user.
    kept = durable(top_k(found, "user_id", [F.col("pos")], max_candidates, "cand_rank"))
    counts = kept.groupBy("user_id").agg(F.max("cand_rank").alias("_found"))
    need = (
        users.select("user_id")
        .distinct()
        .join(counts, "user_id", "left")
        .withColumn("_found", F.coalesce("_found", F.lit(0)))
        .withColumn("need", F.lit(max_candidates) - F.col("_found"))
        .withColumn("need", F.least(F.col("need"), F.lit(n_items)).cast("int"))
        .filter(F.col("need") > 0)
    )
    used = (
        taken.join(order.select("item_id", "pos"), "item_id")
        .select("user_id", "pos")
        .unionByName(kept.select("user_id", "pos"))
        .distinct()
    )
    pad = (
        first_free_positions(need, used, "need")
        .join(order.select("pos", "item_id"), "pos")
        .join(need.select("user_id", "_found"), "user_id")
        .select(
            "user_id",
            "item_id",
            (F.col("rank") + F.col("_found")).cast("int").alias("cand_rank"),
            F.lit("popular").alias("source"),
        )
    )
    return kept.select(
        "user_id", "item_id", "cand_rank", F.lit("cooccurrence").alias("source")
    ).unionByName(pad)
