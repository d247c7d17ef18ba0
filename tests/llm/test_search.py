import numpy as np
import pytest
from helpers import clashing
from pyspark.sql import functions as F

from recspark.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    fine = [(i, np.floor(64 * np.asarray(v, np.float32).astype(float))) for i, v, _ in rows
            if i is not None and v is not None and all(
                x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % 20 == 0:
            best = sorted((-int(sum(a * b for a, b in zip(q, v))), j) for j, v in fine if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:k])]
    return sorted(out)


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 8))
    # Coarse values make many ties.
    return [(i, [float(x) for x in np.round(centre[i // 40 % 5] + rng.normal(size=8), 1)], 0)
            for i in range(n)]


@pytest.mark.parametrize("n", [3, 25, 400])
def test_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(topk_search, "SEGMENT_BLOCKS", 2)
    monkeypatch.setattr(topk_search, "CHUNK", 8)
    rows = vectors(n) + [(1000, None, 1), (1020, [1.0, None], 1), (1040, [float("nan")] * 8, 1),
                         (None, [1.0] * 8, 1), (1060, [float("inf")] * 8, 0), (1080, [], 0),
                         (1100, [0.5, -0.25], None)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3)).drop("label").withColumn(
        "rank", F.lit(1))
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_no_rows(spark):
    assert topk_search.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0
                             ).collect() == []


def test_blocks_are_pruned_and_large_numbers_exact():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (1000, 6))
    v[128:256] *= 40
    ids = np.arange(1000)
    q = v[128:160:10]
    (found,) = [topk_search.search_segment(q, ids[128:160:10], v, ids, 5)]
    for (i, s), own in zip(found, ids[128:160:10]):
        want = sorted(((-int(v[own] @ v[j]), j) for j in ids if j != own))[:5]
        assert [(-int(a), int(b)) for a, b in zip(s, i)] == want
    big = np.array([[2 ** 31, 1], [2 ** 31 - 1, 3], [5, 7]])
    (i, s), = topk_search.search_segment(big[:1], np.array([0]), big, np.array([0, 1, 2]), 2)
    assert s.tolist() == [2 ** 31 * (2 ** 31 - 1) + 3, 5 * 2 ** 31 + 7]
