"""Findings of round 3: the work of a step follows its input, and its rows stay what they were."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recspark.operators import pairs, supports
from recspark.operators.supports import ItemSimilarity, neighbours, similar_item_supports


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def ratings(spark):
    rng = random.Random(3)
    rows = [(u, i, float(rng.randint(1, 5)), f"{u}-{i}")
            for u in range(60) for i in rng.sample(range(40), 25 if u < 2 else rng.randint(1, 9))]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, row_key string")


@pytest.mark.parametrize("limit", [950, 12])
def test_similar_items_are_the_first_unseen_neighbours(ratings, limit):
    recs = ratings.select("user_id").distinct().join(
        ratings.select("item_id").distinct().filter(F.col("item_id") % 9 == 0))
    index = ItemSimilarity.fit(ratings, limit)
    lists = {}
    for r in neighbours(recs, index).collect():
        lists.setdefault(r.anchor, []).append((r.pos, r.item_id))
    seen = {(r.user_id, r.item_id) for r in ratings.collect()}
    want = set()
    for r in recs.collect():
        free = [i for _, i in sorted(lists.get(r.item_id, [])) if (r.user_id, i) not in seen][:3]
        want |= {(r.user_id, r.item_id, k + 1, i) for k, i in enumerate(free)}
    got = similar_item_supports(recs, index).select("user_id", "item_id", "rank", "support_item")
    assert {tuple(r) for r in got.collect()} == want


def test_similar_items_are_looked_up_by_position(ratings):
    """recommendations were held against whole lists, by a range of positions."""
    recs = ratings.select("user_id", (F.col("item_id") % 5).alias("item_id"))
    plan = _plan(similar_item_supports(recs, ItemSimilarity.fit(ratings)))
    assert "pos#" in plan and not any(
        "Join" in line and "<=" in line for line in plan.splitlines())


def test_only_linked_items_meet_the_recommendations(ratings):
    """every well rated item of a user was paired with every recommendation."""
    recs = ratings.select("user_id", F.lit(1).cast("long").alias("item_id"))
    plan = _plan(supports.history_supports(recs, ItemSimilarity.fit(ratings)))
    assert any("Join LeftSemi" in line and "support_item" in line for line in plan.splitlines())


@pytest.mark.parametrize("hot", [100_000, 3])
def test_pairs_travel_with_their_first_item(ratings, monkeypatch, hot):
    """every pair was a row of the shuffle."""
    monkeypatch.setattr(pairs, "HOT_RATERS", hot)
    hist = ratings.select("user_id", "item_id").distinct()
    found = pairs.light_pairs(hist)
    by_user = {}
    for r in hist.collect():
        by_user.setdefault(r.user_id, []).append(r.item_id)
    want = Counter((a, b) for items in by_user.values() for a in items for b in items if a < b)
    assert {(r.item_a, r.item_b): r.n_users for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in x and "item_b" in x for x in plan.splitlines())
    assert "SortMergeJoin [user_id" not in plan
