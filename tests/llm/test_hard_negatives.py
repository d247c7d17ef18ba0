"""Hard negatives against all pairs, and the bounds that leave pairs out."""

import numpy as np
import pytest
from helpers import clashing
from pyspark.sql import functions as F

from recspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, mod=10, positives=5, negatives=10, scale=256):
    fine = []
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v):
            fine.append((i, label, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    anchors = {(i, label, tuple(v)) for i, label, v in fine if i % mod == 0}
    out = []
    for i, label, v in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in fine if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            inside = [(t, k) for t, k, m in sorted(scored) if m != label
                      and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(n, seed=0, dims=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    # Coarse values make many ties.
    return [(i, [float(x) for x in np.round(centre[i % 4] + 0.6 * rng.normal(size=dims), 1)],
             int(rng.integers(0, 3))) for i in range(n)]


def got(df, **kwargs):
    return sorted(map(tuple, hn.hard_negatives(df, anchor_mod=10, **kwargs).collect()))


@pytest.mark.parametrize("n", [2, 30, 500])
def test_against_all_pairs(spark, monkeypatch, n):
    monkeypatch.setattr(hn, "SEGMENT_ROWS", 40)
    monkeypatch.setattr(hn, "CHUNK", 8)
    rows = vectors(n) + [
        (1000, None, 1), (1010, [1.0, None], 1), (1020, [float("nan")] * 8, 1),
        (None, [1.0] * 8, 1), (1030, [float("inf")] * 8, 0), (1040, [], 0), (1050, [0.0] * 8, 1),
        (1060, [0.5, -0.25], 2), (1070, [1.0] * 8, None)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("label", "y"))
    df = df.drop("label").withColumnRenamed("y", "label").withColumn("rank", F.lit(1))
    assert got(df) == brute(rows)


def test_repeated_ids_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hn, "SEGMENT_ROWS", 16)
    monkeypatch.setattr(hn, "CHUNK", 4)
    rows = [(i, v, 0 if i % 3 else y) for i, v, y in vectors(90, 3)]
    rows += [rows[10], rows[10], rows[11]] + [(12, rows[13][1], 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(10, [1.0], 0)], SCHEMA)) == []


def _rows(v, references, ids=None):
    angles, norms = hn.angles_to(v, references)
    n = len(v)
    return hn.Rows(np.arange(n) if ids is None else ids, np.zeros(n, np.int64), v, angles, norms)


def test_bounds_hold_and_exclude():
    """No score leaves its bounds, also for parallel, opposite and zero vectors; on clustered rows
    most pairs are told apart without a score."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(3, 16)) * 100
    v = np.floor(centre[np.arange(300) % 3] + rng.normal(size=(300, 16)) * 5).astype(np.int64)
    v[0], v[1], v[2] = 0, -v[7], v[7] * 3
    a, b = _rows(v[:40], v[5:13]), _rows(v, v[5:13])
    low, high = a.bounds(b)
    exact = v[:40] @ v.T
    assert ((low <= exact) & (exact <= high)).all()
    top = np.sort(exact, axis=1)[:, -20:-19]
    assert (high < top).mean() > 0.4


def test_meetings_leave_out_far_segments(spark, monkeypatch):
    """On clustered rows, pairs of a chunk and a segment are skipped before any vector moves."""
    monkeypatch.setattr(hn, "SEGMENT_ROWS", 50)
    monkeypatch.setattr(hn, "CHUNK", 10)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centre[i % 6] + 0.05 * rng.normal(size=12)], i % 2)
            for i in range(600)]
    seen = {}
    meet = hn.meetings

    def counted(chunks, index, n):
        met = meet(chunks, index, n)
        seen[len(seen)] = (met.count(), chunks.count() * index.count())
        return met

    monkeypatch.setattr(hn, "meetings", counted)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert seen[0][0] < 0.7 * seen[0][1]


def test_scores_beyond_64_bits_stay_at_the_end():
    v = np.array([[1 << 62, 1 << 62], [1 << 62, 1 << 62], [-(1 << 62), 3]])
    rows = _rows(v, v[:1])
    assert rows.scores(rows, 0, np.array([1, 2])).tolist() == [hn.MOST, hn.LEAST]
