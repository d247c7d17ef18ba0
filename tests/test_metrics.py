import math

import pytest
from pyspark.sql import functions as F

from tables import table
from recspark.functions import scores
from recspark.metrics import cold_start, explanation, fairness, rating, topn
from recspark.operators import rerank, topk


def test_rating_errors(spark):
    df = spark.createDataFrame([(3.0, 4.0), (5.0, 5.0), (2.0, 4.0)], "prediction double, rating double")
    row = rating.rating_errors(df).first()
    assert row["MAE"] == pytest.approx(1.0) and row["RMSE"] == pytest.approx(math.sqrt(5 / 3))


@pytest.fixture(scope="module")
def tiny(spark):
    lists = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "user_id string, item_id string, rank int")
    train = spark.createDataFrame(
        [("a", "p", 5.0), ("a", "q", 3.0), ("b", "p", 4.0), ("c", "p", 4.0)],
        "user_id string, item_id string, rating double")
    test = spark.createDataFrame(
        [("a", "y", 5.0), ("a", "y", 4.0), ("a", "w", 4.0), ("b", "x", 2.0), ("c", "x", 5.0)],
        "user_id string, item_id string, rating double")
    return lists, train, test


def test_repeated_relevant_rows_count_in_recall_only(tiny):
    lists, train, test = tiny
    users = topn.evaluation_users(train, test, 1, 4.0)
    rows = {r["user_id"]: r for r in topn.list_metrics(lists, users, test, 2, 4.0).collect()}
    assert set(rows) == {"a", "c"}
    assert rows["a"]["precision"] == 0.5
    assert rows["a"]["recall"] == pytest.approx(1 / 3)
    ideal = 1 + 1 / math.log2(3)
    assert rows["a"]["ndcg"] == pytest.approx((1 / math.log2(3)) / ideal)
    assert rows["c"]["ndcg"] == 0.0


def test_f_measure_is_taken_from_the_means(tiny):
    lists, train, test = tiny
    row = topn.evaluate_recommendations(lists, train, test, 2, 1, 4.0).first()
    p, r = 0.25, 1 / 6
    assert row["F-measure"] == pytest.approx(2 * p * r / (p + r)) and row["n_users_eval"] == 2


def test_no_users_gives_zeros(tiny):
    lists, train, test = tiny
    row = topn.evaluate_recommendations(lists, train, test, 2, 99, 4.0).first()
    assert row["Precision"] == 0 and row["NDCG"] == 0 and row["n_users_eval"] == 0


PER_USER = "user string, n_train long, precision double, recall double, ndcg double"


def test_buckets_and_ratio(spark):
    df = spark.createDataFrame(
        [("a", 2, .1, .1, .1), ("b", 3, .1, .1, .2), ("c", 20, .2, .2, .4), ("d", 30, .2, .2, .4)],
        PER_USER)
    summary = fairness.summarize_by_activity(df, 2).orderBy("bucket").collect()
    assert [r["n_users"] for r in summary] == [2, 2]
    assert summary[0]["mean_hit_rate"] is None
    ratio = fairness.disparity_ratios(fairness.summarize_by_activity(df, 2)).first()
    assert ratio["precision"] == pytest.approx(2.0) and ratio["hit_rate"] is None
    gap = fairness.cold_warm_gap(df).first()
    assert gap["n_cold_users"] == 2 and gap["cold_warm_ndcg_gap"] == pytest.approx(0.25)


def test_single_activity_level_and_empty_input(spark):
    df = spark.createDataFrame([("a", 5, .1, .1, .0), ("b", 5, .1, .1, .2)], PER_USER)
    rows = fairness.summarize_by_activity(df).collect()
    assert len(rows) == 1 and rows[0]["bucket"] == 5
    assert fairness.disparity_ratios(fairness.summarize_by_activity(df)).first()["ndcg"] is None
    empty = df.limit(0)
    assert fairness.summarize_by_activity(empty).count() == 0
    assert fairness.cold_warm_gap(empty).first()["warm_mean_ndcg"] == 0.0


def test_cold_start_deltas(spark):
    cols = "cold_mean_precision double, cold_mean_recall double, cold_mean_ndcg double, warm_mean_ndcg double"
    a = spark.createDataFrame([(.1, .2, .3, .4)], cols)
    b = spark.createDataFrame([(.2, .2, .5, .3)], cols)
    row = cold_start.compare_cold_start(a, b, "x").first()
    assert row["x_cold_ndcg_delta"] == pytest.approx(.2)
    assert row["x_warm_ndcg_delta"] == pytest.approx(-.1)


def test_position_scores_and_fusion_ends(spark):
    pool = spark.createDataFrame(
        [("u", "a", 1), ("u", "b", 2), ("u", "c", 3), ("v", "a", 1)],
        "user_id string, item_id string, rank int")
    text = spark.createDataFrame([("u", "c", 0.9), ("u", "b", 0.1)],
                                 "user_id string, item_id string, text_sim double")
    got = {(r["user_id"], r["item_id"]): r["cf_score"]
           for r in rerank.position_scores(pool).collect()}
    assert got == {("u", "a"): 1.0, ("u", "b"): 0.5, ("u", "c"): 0.0, ("v", "a"): 1.0}
    order = lambda a: [r["item_id"] for r in rerank.late_fusion(pool, text, a)
                       .filter("user_id = 'u'").orderBy("rank").collect()]
    assert order(1.0) == ["a", "b", "c"] and order(0.0) == ["c", "b", "a"]


def test_adjustment(spark):
    lists = spark.createDataFrame(
        [("u", "a", 1, 1.0), ("u", "b", 2, 0.9), ("v", "a", 1, None), ("v", "b", 2, None)],
        "user_id string, item_id string, rank int, score double")
    expl = spark.createDataFrame([("u", "b", 1.0)],
                                 "user_id string, recommended_item string, support_confidence double")
    assert rerank.adjust_scores(lists, expl, enabled=False) is lists
    out = rerank.adjust_scores(lists, expl, None, True, 0.2, 0.1)
    got = {(r["user_id"], r["rank"]): r for r in out.collect()}
    assert got["u", 1]["item_id"] == "b" and got["u", 1]["base_rank"] == 2
    assert got["v", 1]["effective_base_score"] == -1.0
    assert got["v", 1]["effective_base_score_source"] == "rank_fallback"


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame(
        [], "supporting_history array<int>, supporting_similar_items array<int>, "
            "support_confidence double")
    row = explanation.evaluate_explanations(empty).first()
    assert row["explanation_coverage"] == 0.0 and row["mean_support_confidence"] == 0.0


def test_first_free_positions(spark):
    users = spark.createDataFrame([(1, 3), (2, 3), (3, 2)], "user_id int, need int")
    taken = spark.createDataFrame(
        [(1, 1), (1, 2), (1, 5), (2, 9)] + [(3, p) for p in range(1, 8)], "user_id int, pos int")
    got = topk.first_free_positions(users, taken, "need", block=2)
    assert table(got, "user_id", "pos", "rank") == sorted(
        [(1, 3, 1), (1, 4, 2), (1, 6, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 8, 1), (3, 9, 2)],
        key=str)


def test_score_functions(spark):
    row = spark.range(1).select(
        scores.safe_double(F.lit("x")).alias("bad"),
        scores.clip_rating(F.lit(float("nan")), F.lit(3.3)).alias("nan"),
        scores.clip_rating(F.lit(7.0), F.lit(3.3)).alias("high"),
        scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        scores.ratio_text(F.lit(2), F.lit(7)).alias("text"),
        scores.ratio_text(F.lit(3), F.lit(3)).alias("one"),
    ).first()
    assert row["bad"] is None and row["nan"] == 3.3 and row["high"] == 5.0 and row["zero"] == 0.0
    assert row["text"] == "0.29" and row["one"] == "1.00"
