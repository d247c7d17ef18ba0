"""What is left on disk after a stored table, and blocks that grow with the ratings."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recspark.models import latent, pairwise
from recspark.skew import SHUFFLE_CLEANUP, checkpoint_dir, discard, durable


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    found = blocks.diskBlockManager().getAllFiles().mkString(",").split(",")
    return {os.path.basename(f) for f in found if os.path.basename(f).startswith("shuffle_")}


def tables(spark):
    return {p.name for p in Path(checkpoint_dir(spark).removeprefix("file:")).iterdir()}


@pytest.fixture
def train(spark):
    return spark.createDataFrame(
        [(u, i, float(1 + (u * i) % 5)) for u in range(30) for i in range(25) if (u + i) % 3],
        "user_id long, item_id long, rating double")


def test_a_stored_table_leaves_no_shuffle_files(spark):
    df = spark.range(50_000).groupBy((F.col("id") % 997).alias("k")).count()
    before = shuffle_files(spark)
    stored = durable(df)
    assert not shuffle_files(spark) - before
    assert stored.agg(F.sum("count")).first()[0] == 50_000
    assert df.agg(F.sum("count")).first()[0] == 50_000  # the same frame, planned again
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None


def test_discard_deletes_one_table_only(spark):
    kept, gone = durable(spark.range(5)), durable(spark.range(6))
    before = tables(spark)
    discard(gone)
    assert len(before - tables(spark)) == 1 and kept.count() == 5
    discard(spark.range(3))  # no files: nothing happens


@pytest.mark.parametrize("rule", ["first_non_positive", "first_violator"])
def test_training_keeps_one_parameter_table(spark, train, rule):
    """As many tables stay after six epochs as after two."""
    left = []
    for n_epochs in (2, 6):
        before = tables(spark)
        pairwise.fit_pairwise(train, "warp", "uniform", 4, n_epochs, trial_rule=rule, max_trials=3)
        left.append(len(tables(spark) - before))
    assert left[0] == left[1]


def test_blocks_grow_with_the_ratings(spark, train, monkeypatch):
    asked = []

    class Fitted(latent.ALS):
        def fit(self, rows):
            asked.append((self.getNumUserBlocks(), self.getNumItemBlocks()))
            return super().fit(rows)

    monkeypatch.setattr(latent, "ALS", Fitted)
    for size in (latent.BLOCK_RATINGS, 30):
        monkeypatch.setattr(latent, "BLOCK_RATINGS", size)
        u, i = latent.fit_als(train, "rating", 3, 0.1, 2)
        assert u.count() == 30 and i.count() == 25
    n = -(-train.count() // 30)
    assert asked == [(10, 10), (n, n)] and n > 10
