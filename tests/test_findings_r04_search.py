"""Catalogue search in single precision with a bound of its error."""

import numpy as np

from recspark.models import scoring
from recspark.operators.topk import rank_by_score


def test_close_scores_across_chunks(spark):
    """Scores that single precision cannot tell apart, ties, chunks of one block: exact lists."""
    rng = np.random.default_rng(7)
    u = rng.integers(1, 5, (40, 6)).astype(float)
    v = 3e3 + rng.integers(0, 3, (150, 6)) * 2.0 ** -8
    v[60:] = v[:90]
    uf, vf = [spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(m)],
                                    f"{c} long, features array<float>")
              for m, c in ((u, "user_id"), (v, "item_id"))]
    none = spark.createDataFrame([], "user_id long, item_id long")
    got = rank_by_score(scoring.top_items(uf, vf, 7, none, None, 16, 20, 1), 7)
    v = v.astype(np.float32).astype(float)
    want = [(a, b, k) for a in range(40) for k, b in enumerate(
        sorted(range(150), key=lambda b: (-round(float(u[a] @ v[b]), 9), b))[:7], 1)]
    assert sorted((r["user_id"], r["item_id"], r["rank"]) for r in got.collect()) == sorted(want)


def test_user_blocks_hold_vectors_as_bytes(spark):
    """Vectors reach the search as bytes, and only once per user block and chunk."""
    uf = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "user_id long, features array<float>")
    places = spark.createDataFrame([(5, 2), (6, 0)], "item_id long, pos long")
    seen = spark.createDataFrame([(0, 5), (0, 6), (3, 7), (99, 5)], "user_id long, item_id long")
    rows = scoring._user_blocks(uf, places, 2, 2, seen, None).collect()
    assert sum(len(r["ids"]) for r in rows) == 9
    assert all(len(r["vec"]) == 8 * len(r["ids"]) for r in rows)
    pairs = {(r["ids"][a], int(p)) for r in rows for a, p in zip(
        np.frombuffer(r["seen_at"], "<i4"), np.frombuffer(r["seen_pos"], "<i8"))}
    assert pairs == {(0, 2), (0, 0)}
