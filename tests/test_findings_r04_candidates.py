"""Candidates are read from the front of the lists, as far as a user needs them."""

import pytest

from recspark.operators import candidates
from recspark.operators.stats import history, item_stats, popularity_order


def wanted(train, cap, taken):
    """Per user the first positions of untaken items that a rater of an own item rated."""
    pairs = {(r["user_id"], r["item_id"]) for r in history(train).collect()}
    pos = {r["item_id"]: r["pos"] for r in popularity_order(item_stats(train)).collect()}
    items, raters = {}, {}
    for u, i in pairs:
        items.setdefault(u, set()).add(i)
        raters.setdefault(i, set()).add(u)
    out = {}
    for u, own in items.items():
        reached = {j for i in own for v in raters[i] for j in items[v] if j != i or len(own) > 1}
        reached -= {i for v, i in taken if v == u} | own
        out[u] = sorted(pos[i] for i in reached)[:cap]
    return {u: x for u, x in out.items() if x}


@pytest.mark.parametrize("limit, first, cap", [(950, 1, 9), (12, 2, 40)])
def test_how_far_lists_are_read_does_not_matter(spark, skewed, monkeypatch, limit, first, cap):
    monkeypatch.setattr(candidates, "FIRST_PLACES", first)
    taken = [(u, (u * 7) % 30) for u in range(0, 40, 2)]
    extra = spark.createDataFrame(taken, "user_id long, item_id long")
    users = skewed.select("user_id").distinct()
    got = {}
    for r in candidates.candidate_items(users, skewed, cap, 0, extra, limit).collect():
        if r["source"] == "cooccurrence":
            got.setdefault(r["user_id"], []).append((r["cand_rank"], r["item_id"]))
    pos = {r["item_id"]: r["pos"] for r in popularity_order(item_stats(skewed)).collect()}
    got = {u: [pos[i] for _, i in sorted(x)] for u, x in got.items()}
    assert got == wanted(skewed, cap, taken)


def test_only_the_front_of_a_list_is_met(spark, monkeypatch):
    """One long list among many: a user who is done after the first round meets no more of it."""
    monkeypatch.setattr(candidates, "FIRST_PLACES", 8)
    steps = spark.createDataFrame([(1, 10, 1), (2, 10, 90)], "user_id long, anchor long, n_taken long")
    short = spark.createDataFrame([(10, p) for p in range(1, 101)], "anchor long, pos long")
    met, stored = [], candidates.durable

    def seen(df):
        out = stored(df)
        if "done" in out.columns:
            met.append(out.count())
        return out

    monkeypatch.setattr(candidates, "durable", seen)
    got = candidates._along_lists(steps, short, 5, 100).collect()
    assert met == [2, 1, 1]
    assert sorted((r["user_id"], r["pos"]) for r in got) == [(1, p) for p in range(1, 7)] + [
        (2, p) for p in range(1, 96)]
