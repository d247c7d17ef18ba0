"""Pruned catalogue search against all products."""

import numpy as np
import pytest

from recspark.models.scoring import best_of_block, top_items
from recspark.operators.topk import rank_by_score
from tables import table

PAIR = "user_id string, item_id long"


def frames(spark, u, v):
    uf = spark.createDataFrame([(f"u{i:02d}", [float(x) for x in r]) for i, r in enumerate(u)],
                               "user_id string, features array<double>")
    vf = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)],
                               "item_id long, features array<double>")
    return uf, vf


def brute(u, v, n, seen=(), cand=None):
    want = []
    for a in range(len(u)):
        ok = [b for b in range(len(v)) if (f"u{a:02d}", b) not in seen
              and (cand is None or (f"u{a:02d}", b) in cand)]
        best = sorted(ok, key=lambda b: (-float(u[a] @ v[b]), b))[:n]
        want += [(f"u{a:02d}", b, k) for k, b in enumerate(best, 1)]
    return sorted(want, key=str)


@pytest.mark.parametrize("restricted", [False, True])
def test_block_scoring(spark, restricted):
    rng = np.random.default_rng(1)
    u, v = rng.integers(-3, 4, (25, 3)), rng.integers(-3, 4, (40, 3))
    u[3], v[5], v[6] = 0, 0, 0
    uf, vf = frames(spark, u, v)
    seen = {(f"u{a:02d}", int(b)) for a, b in zip(*np.nonzero(rng.random((25, 40)) < 0.3))}
    cand = {(f"u{a:02d}", int(b)) for a, b in zip(*np.nonzero(rng.random((25, 40)) < 0.4))}
    got = rank_by_score(top_items(
        uf, vf, 5, spark.createDataFrame(sorted(seen), PAIR),
        spark.createDataFrame(sorted(cand), PAIR) if restricted else None, 7, 11, 200), 5)
    assert table(got, "user_id", "item_id", "rank") == brute(u, v, 5, seen, cand if restricted else None)


def test_blocks_of_short_vectors_are_left_out(spark):
    """Lengths that fall off: the same lists, and few pairs of blocks meet."""
    rng = np.random.default_rng(2)
    u = rng.integers(1, 9, (60, 4))
    v = rng.integers(1, 9, (400, 4)) * np.where(np.arange(400) % 10 == 0, 8, 1)[:, None]
    uf, vf = frames(spark, u, v)
    met = []
    nothing = spark.createDataFrame([], PAIR)
    got = rank_by_score(top_items(uf, vf, 5, nothing, None, 16, 40,
                                  observe=lambda *x: met.append(x)), 5)
    assert table(got, "user_id", "item_id", "rank") == brute(u, v, 5)
    assert met[0][0] <= met[0][1] / 2


def test_users_who_saw_the_long_items_meet_the_others(spark):
    rng = np.random.default_rng(3)
    u, v = rng.integers(1, 9, (6, 4)), rng.integers(1, 9, (100, 4))
    v[:20] *= 50
    seen = {(f"u{a:02d}", b) for a in (0, 1) for b in range(20)} | {("u02", 99), ("zz", 3)}
    got = rank_by_score(top_items(*frames(spark, u, v), 4,
                                  spark.createDataFrame(sorted(seen), PAIR), None, 4, 20), 4)
    assert table(got, "user_id", "item_id", "rank") == brute(u, v, 4, seen)


def test_scores_do_not_depend_on_the_block_shape():
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(50, 33)), rng.normal(size=(300, 33))
    whole = best_of_block(u, v, np.ones((50, 300), bool), np.arange(300), 300, np.full(50, -np.inf))
    part = best_of_block(u[:7], v[:90], np.ones((7, 90), bool), np.arange(90), 90,
                         np.full(7, -np.inf))
    scores = {(r, c): s for r, c, s in zip(*whole)}
    assert all(scores[r, c] == s for r, c, s in zip(*part))
