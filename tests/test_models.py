"""Learned models on planted data; pairwise models and scoring have files of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tables import table
from recspark.metrics import rating, topn
from recspark.models import latent
from recspark.models.hybrid import ContentHybrid
from recspark.models.implicit_als import ImplicitALS
from recspark.models.mf import MatrixFactorization
from recspark.models.popularity import Popularity
from recspark.models.registry import RANKERS, fit_ranker
from recspark.operators import split


@pytest.fixture(scope="module")
def planted(spark):
    """Rank-4 preferences: rating = clip(round(3 + u.v)), a fifth of the cells observed."""
    rng = np.random.default_rng(3)
    u, v = rng.normal(0, 1, (300, 4)), rng.normal(0, 1, (120, 4))
    score = np.clip(np.round(3 + u @ v.T), 1, 5)
    rows = [(int(a), int(b), float(score[a, b]), f"{a}-{b}")
            for a, b in zip(*np.nonzero(rng.random((300, 120)) < 0.2))]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double, k string")
    s = split.split_per_user(df.withColumn("row_key", split.split_key(42, "k"))).persist()
    return split.train_part(s).persist(), split.test_part(s).persist()


def _ndcg(model, planted):
    train, test = planted
    lists = model.rank(train.select("user_id").distinct(), 10)
    return topn.evaluate_recommendations(lists, train, test, 10, 5, 4.0).first()["NDCG"]


@pytest.fixture(scope="module")
def popularity_ndcg(planted):
    return _ndcg(Popularity.fit(planted[0]), planted)


def test_mf_beats_item_means(planted):
    train, test = planted
    base = rating.evaluate_rating_prediction(Popularity.fit(train), test).first()
    model = MatrixFactorization.fit(train, 8, 0.05, 8)
    got = rating.evaluate_rating_prediction(model, test).first()
    assert got["RMSE"] < 0.9 * base["RMSE"]


def test_als_keeps_the_shuffle_files_of_one_iteration(planted, monkeypatch):
    made = []

    class Noted(latent.ALS):
        def __init__(self, **kwargs):
            super().__init__(**kwargs)
            made.append(self)

    monkeypatch.setattr(latent, "ALS", Noted)
    MatrixFactorization.fit(planted[0], 4, 0.1, 3)
    ImplicitALS.fit(planted[0], 4, 3)
    assert [als.getCheckpointInterval() for als in made] == [1, 1]
    assert planted[0].sparkSession.sparkContext.getCheckpointDir()


def test_mf_candidates_match_catalogue_when_they_cover_it(planted):
    train, _ = planted
    model = MatrixFactorization.fit(train, 4, 0.1, 2)
    users = train.select("user_id").distinct().limit(20)
    whole = model.rank(users, 5)
    pooled = model.rank(users, 5, max_candidates=119)
    shared = table(whole, "user_id", "item_id")
    assert len(set(shared) & set(table(pooled, "user_id", "item_id"))) >= 0.9 * len(shared)


def test_implicit_als_beats_popularity(planted, popularity_ndcg):
    assert _ndcg(ImplicitALS.fit(planted[0], 8, 8, 0.05), planted) > 1.3 * popularity_ndcg


def test_ablation(spark, planted):
    train, _ = planted
    model = ImplicitALS.fit(train, 8, 5, 0.05)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    mine = train.join(users, "user_id", "left_semi").select("user_id", "item_id")
    drops = mine.filter("user_id = 2").unionByName(
        mine.filter("user_id = 3").orderBy("item_id").limit(3))
    normal = {u: [i for x, i, _ in table(model.rank(users, 8), "user_id", "item_id", "rank")
                  if x == u] for u in (1, 2, 3)}
    cut = model.rank_without(users, drops, 8)
    got = {u: [i for x, i, _ in table(cut, "user_id", "item_id", "rank") if x == u]
           for u in (1, 2, 3)}
    assert got[1] == normal[1] and got[2] == [] and len(got[3]) == 8
    kept = {r["user_id"] for r in model.rank_without(users, drops, 8, mode="filter_only").collect()}
    assert kept == {1, 3}


def test_fold_in_gives_back_trained_factors_and_adds_up_in_parts(planted):
    """Users are solved last against earlier item factors, so only the direction is compared."""
    train, _ = planted
    model = ImplicitALS.fit(train, 8, 15, 0.05)
    whole = {r["user_id"]: np.array(r["features"]) for r in
             model.fold_in(model.positives()).collect()}
    parts = {r["user_id"]: np.array(r["features"]) for r in
             model.fold_in(model.positives(), max_rows=4).collect()}
    trained = {r["user_id"]: np.array(r["features"]) for r in model.user_factors.collect()}
    assert set(whole) == set(parts)
    assert all(np.allclose(whole[u], parts[u], atol=1e-4) for u in whole)
    cos = [whole[u] @ trained[u] / np.linalg.norm(whole[u]) / np.linalg.norm(trained[u])
           for u in whole]
    assert np.mean(cos) > 0.98


def test_removed_items_by_correction_are_as_solved_anew(spark, planted, monkeypatch):
    """Many drop sets per user, sums of parts, sets that leave nothing and items never rated."""
    import recspark.models.implicit_als as module

    monkeypatch.setattr(module, "PART_ROWS", 5)
    train, _ = planted
    model = ImplicitALS.fit(train, 8, 5, 0.05)
    mine = {}
    for r in model.positives().collect():
        mine.setdefault(r["user_id"], []).append(r["item_id"])
    rng = np.random.default_rng(0)
    sets = {}
    for u in sorted(mine)[:12]:
        for k in range(6):
            sets[u, k] = sorted(rng.choice(mine[u], min(len(mine[u]) - 1, 1 + k), False).tolist())
        sets[u, 6] = mine[u]
        sets[u, 7] = [999]
        sets[u, 8] = mine[u][:1] + [999]
    rows = [(u, k, i) for (u, k), items in sets.items() for i in items] + [(-5, 0, 3)]
    drops = spark.createDataFrame(rows, "user_id long, drop_id long, item_id long")
    got = {(r["user_id"], r["drop_id"]): np.array(r["features"]) for r in
           model.fold_out(drops).collect()}
    positives = model.positives()
    for k in range(9):
        gone = drops.filter(F.col("drop_id") == k).select("user_id", "item_id")
        left = positives.join(gone.select("user_id").distinct(), "user_id", "left_semi").join(
            gone, ["user_id", "item_id"], "left_anti")
        want = {r["user_id"]: np.array(r["features"]) for r in model.fold_in(left).collect()}
        assert set(want) == {u for u, j in got if j == k}
        assert all(np.allclose(got[u, k], want[u], atol=1e-4) for u in want)


class _Text:
    def score(self, pool):
        return pool.select("user_id", "item_id", (F.col("item_id") % 10 / 10).alias("text_sim"))


def test_hybrid(spark, skewed):
    base = Popularity.fit(skewed)
    users = spark.createDataFrame([(5,), (8,), (999,)], "user_id long")
    hybrid = ContentHybrid(base, _Text(), skewed, alpha=0.0, cold_alpha=0.0, pool_size=12)
    got = hybrid.rank(users, 4)
    for u in (5, 8):
        pool = [r["item_id"] for r in base.rank(users, 12).filter(F.col("user_id") == u)
                .orderBy("rank").collect()]
        want = sorted(pool, key=lambda i: (-(i % 10), pool.index(i)))[:4]
        assert [r["item_id"] for r in got.filter(F.col("user_id") == u)
                .orderBy("rank").collect()] == want
    stranger = [r["item_id"] for r in got.filter("user_id = 999").orderBy("rank").collect()]
    assert stranger == [r["item_id"] for r in base.popular_items(4).collect()]
    off = ContentHybrid(base, _Text(), skewed, enabled=False)
    assert table(off.rank(users, 4)) == table(base.rank(users, 4))


def test_registry(skewed):
    assert len(RANKERS) == 7
    assert fit_ranker("popularity", skewed).popular_items(1).count() == 1
    with pytest.raises(KeyError):
        fit_ranker("nothing", skewed)
