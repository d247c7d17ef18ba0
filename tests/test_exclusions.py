"""Exclusions, tied scores and exhausted draws: cases in which a prefix must not cut an answer."""

import pytest
from tables import table

from recspark.models.item_cf import ItemCF
from recspark.models.popularity import Popularity
from recspark.operators import negatives
from recspark.operators.candidates import candidate_items

RATED = "user_id long, item_id long, rating double, row_key string"


def rated(spark, pairs):
    return spark.createDataFrame(
        [(u, i, float(r), f"{k:04d}") for k, (u, i, r) in enumerate(pairs)], RATED)


@pytest.mark.parametrize("limit", [2, 950])
def test_candidates_reach_past_excluded_items(spark, limit):
    rows = [(1, 1, 4)] + [(u, i, 4) for u in (2, 3, 4) for i in (1, 2, 3)]
    rows += [(5, 1, 4), (5, 4, 4)] + [(u, 9, 3) for u in range(10, 20)]
    train = rated(spark, rows)
    users = spark.createDataFrame([(1,)], "user_id long")
    exclude = spark.createDataFrame([(1, 2), (1, 3)], "user_id long, item_id long")
    got = candidate_items(users, train, 1, 0, exclude, limit)
    assert table(got, "item_id", "source") == [(4, "cooccurrence")]
    assert table(candidate_items(users, train, 2, 0, exclude, limit), "item_id") == [(4,), (9,)]


def test_popularity_skips_excluded_items(spark):
    train = rated(spark, [(u, i, 4) for i in range(1, 8) for u in range(20 - i)])
    users = spark.createDataFrame([(19,), (50,)], "user_id long")
    exclude = spark.createDataFrame([(50, 1), (50, 2), (50, 4)], "user_id long, item_id long")
    got = Popularity.fit(train).rank(users, 2, exclude)
    assert table(got, "user_id", "item_id", "rank") == [(19, 1, 1), (19, 2, 2), (50, 3, 1),
                                                        (50, 5, 2)]


def test_tied_means_keep_their_order(spark):
    # Items 5 and 10 both average 4 2/3; nothing connects them with user 1.
    rows = [(1, 1, 3)] + [(u, i, r) for i in (10, 5) for u, r in ((20 + i, 5), (40 + i, 5),
                                                                 (60 + i, 4))]
    model = ItemCF.fit(rated(spark, rows + [(80, 7, 2)]))
    users = spark.createDataFrame([(1,)], "user_id long")
    longest = [r["item_id"] for r in model.rank(users, 3).orderBy("rank").collect()]
    assert longest == [5, 10, 7]
    for n in (1, 2):
        assert [r["item_id"] for r in model.rank(users, n).orderBy("rank").collect()
                ] == longest[:n]


@pytest.mark.parametrize("tries", [0, 1, 3])
def test_every_positive_gets_a_negative(spark, tries):
    # User 1 likes all items but one, user 2 all of them.
    rows = [(1, i) for i in range(9)] + [(2, i) for i in range(10)]
    pos = spark.createDataFrame(rows, "user_id long, item_id long")
    index = spark.createDataFrame([(i, i) for i in range(10)], "item_id long, item_idx int")
    plain = negatives.sample_negatives(pos, index, tries=tries)
    hard = negatives.sample_negatives(pos, index, "cooccurrence", hist=pos, tries=max(tries, 1),
                                      uniform_tries=tries)
    for drawn in (plain, hard):
        assert table(drawn, "user_id", "item_id") == sorted(rows, key=str)
