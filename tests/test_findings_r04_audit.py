"""Audits of lists make every product, in whole blocks whose vectors travel as bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recspark.functions.blocks import products, rough_products
from recspark.metrics import list_audit


@pytest.fixture
def factors(spark):
    rng = np.random.default_rng(11)
    u, v = rng.normal(size=(90, 5)), rng.normal(size=(130, 5)) * rng.random((130, 1)) * 1000
    frames = [spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(m)],
                                    f"{c} long, features array<double>")
              for m, c in ((u, "user_id"), (v, "item_id"))]
    return u, v, *frames


def counted(u, v, lists, seen, n):
    out = {}
    for a in range(len(u)):
        own = lists.get(a)
        if own:
            last = min(s for _, s in own) if len(own) >= n else -np.inf
            known = {i for i, _ in own} | seen.get(a, set())
            out[a] = sum(s > last + list_audit.TOLERANCE and i not in known
                         for i, s in enumerate(v @ u[a]))
    return out


def test_what_is_left_out_does_not_depend_on_blocks(spark, factors, monkeypatch):
    """Missing items, short lists and users without one, over one block and over many."""
    u, v, users, items = factors
    rng = np.random.default_rng(5)
    lists, seen = {}, {}
    for a in range(80):
        score = v @ u[a]
        order = np.argsort(-score)
        take = order[:6] if a % 3 else order[[0, 2, 3, 5, 9, 12]]
        lists[a] = [(int(i), float(score[i])) for i in take[:4 if a % 7 == 0 else 6]]
        seen[a] = {int(i) for i in rng.choice(130, 9)}
    ldf = spark.createDataFrame([(a, i, s) for a, x in lists.items() for i, s in x],
                                "user_id long, item_id long, score double")
    sdf = spark.createDataFrame([(a, i) for a, x in seen.items() for i in x] + [(500, 1), (1, 500)],
                                "user_id long, item_id long")
    want = counted(u, v, lists, seen, 6)
    for user_block, item_block in ((4096, 8192), (17, 23)):
        monkeypatch.setattr(list_audit, "USER_BLOCK", user_block)
        monkeypatch.setattr(list_audit, "ITEM_BLOCK", item_block)
        got = list_audit.left_out(ldf, users, items, sdf, 6)
        assert {r["user_id"]: r["left_out"] for r in got.collect()} == want


def test_rows_of_a_tile_do_not_hold_python_objects(spark, factors):
    """A block reaches its products as bytes, not as one object per row."""
    u = list_audit._blocks(factors[2].withColumn("last", F.lit(0.0)), "user_id", 90, 40, "u", 3)
    assert dict(u.dtypes)["u_vec"] == "binary"
    assert sum(len(r["u_ids"]) for r in u.collect()) == 90


def test_error_of_single_precision_is_bounded():
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=(700, 64)), rng.normal(size=(300, 64)) * 1e3
    for part, rough, error in rough_products(u, v):
        assert (np.abs(rough - u[part] @ v.T) <= error[:, None]).all()
    big = [r for _, r, _ in rough_products(u[:2] * 1e30, v)]
    assert big[0].dtype == np.float64
    rows, cols = np.nonzero(np.ones((5, 7)))
    assert np.allclose(products(u, v, rows, cols).reshape(5, 7), u[:5] @ v[:7].T)
