"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()
# Lists without SQL; those of the other learned models are audited whole by queries with SQL.
RANKINGS = ["mf_top_n", "mf_candidate_top_n", "implicit_als_top_n"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", RANKINGS)
def test_learned_lists_are_well_formed(spark, name):
    lists = QUERIES[name](spark, SF).persist()
    train = entry._train(spark, SF)
    assert lists.count() > 0
    assert lists.join(train, ["user_id", "item_id"], "left_semi").count() == 0
    bad = lists.groupBy("user_id").agg(
        F.max("rank").alias("m"), F.count("*").alias("n"), F.count_distinct("item_id").alias("d")
    ).filter("m <> n or d <> n or n > 10")
    assert bad.count() == 0


def test_entry_runs(spark):
    row = entry.entry(spark).first()
    assert 0 <= row["Precision"] <= 1 and row["n_users_eval"] > 0
