import random

import numpy as np
import pytest
from helpers import awkward, clashing, frame, near_components

from recspark.llm import near_dedup
from recspark.llm.common import stored
from recspark.llm.components import components
from recspark.llm.words import Words, batches, shingle_sets


def result(df):
    return sorted(map(tuple, near_dedup.near_duplicates(df).select(
        "doc_id", "n_shingles", "component_id").collect()), key=str)


def test_awkward_rows(spark):
    rows = awkward()
    assert result(clashing(frame(spark, rows))) == near_components(rows)
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(1, None, None, None, None)])) == [(1, 0, 1)]


def chains(rng, groups=6, size=25):
    """Groups of drifting copies, some linked only through others, and a passage many share."""
    rows, i = [], 0
    passage = [f"p{k}" for k in range(50)]
    for g in range(groups):
        words = [f"g{g}w{k}" for k in range(120)]
        for _ in range(size):
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(120)] = f"e{rng.random()}"
            rows.append((i, " ".join(words), "en", "s", 1))
            i += 1
    for _ in range(40):
        own = [f"o{rng.randrange(10**9)}" for _ in range(rng.randint(10, 120))]
        rows.append((i, " ".join(own[:5] + passage + own[5:]), "en", "s", 1))
        i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_passages(spark, seed):
    rows = chains(random.Random(seed))
    assert result(frame(spark, rows)) == near_components(rows)


@pytest.mark.parametrize("hot", [2, 12])
def test_long_lists_in_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "MAX_ROUNDS", hot % 2)
    rows = chains(random.Random(9), groups=3, size=30)
    assert result(frame(spark, rows)) == near_components(rows)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(near_dedup, "PRODUCT", 7)
    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(k)] for k in (5, 9))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert near_dedup._shared_counts(x, y).tolist() == want


def test_borderline_similarities(spark):
    # 4 of 5, 8 of 10 and just below: single-word shingle sets through short and longer texts.
    rows = []
    for n, drop in ((9, 1), (14, 2), (24, 4), (24, 5), (54, 9), (54, 10), (104, 20)):
        a = [f"n{n}d{drop}w{k}" for k in range(n)]
        rows.append((len(rows), " ".join(a), "en", "s", 0))
        rows.append((len(rows), " ".join(a[:n - drop]), "en", "s", 0))
    assert result(frame(spark, rows)) == near_components(rows)


def test_group_of_copies_makes_a_row_per_member(spark, monkeypatch):
    seen = []
    real = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified",
                        lambda p, s: seen.append(p.count()) or real(p, s))
    rng = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(words), "en", "s", 1))
    assert {r[2] for r in result(frame(spark, rows))} == {0}
    assert sum(seen) < 150 * 12


def test_without_near_copies(spark):
    rows = awkward()
    kept = near_dedup.without_near_copies(frame(spark, rows)).collect()
    named = {c for _, n, c in near_components(rows)}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == named - {None}
    assert kept[0].asDict().keys() == frame(spark, rows).first().asDict().keys()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    edges += [(k, k + 1) for k in range(200, 240)] + [(500, 500)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    want = {n: root(n) for n in up if n != 500}
    got = components(stored(spark.createDataFrame(edges, "a long, b long")))
    assert {r["node"]: r["label"] for r in got.collect()} == want


def test_word_positions_and_hashes():
    texts = ["a b", "", None, " x\t\ny ", "Größe A a", "z"]
    raw = next(batches(texts))
    w = Words(raw)
    assert w.counts.tolist() == [2, 0, 0, 2, 3, 1]
    h = w.hashes()
    assert h[0] == h[5] == h[6] and len(np.unique(h)) == 6
    assert [len(s) for s in shingle_sets(raw, 2)] == [1, 0, 0, 1, 2, 1]
