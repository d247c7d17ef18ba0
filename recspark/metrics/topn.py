"""Top-N accuracy: precision, recall, F-measure, NDCG, candidate hit rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import f_measure, ideal_dcg, mean_or_zero, rank_discount
from ..operators.stats import history, history_sizes, item_popularity, with_scalars


def relevant_rows(test: DataFrame, relevance_threshold: float | None = None) -> DataFrame:
    rows = test if relevance_threshold is None else test.filter(
        F.col("rating") >= float(relevance_threshold)
    )
    return rows.select("user_id", "item_id")


def evaluation_users(
    train: DataFrame,
    test: DataFrame,
    min_train_ratings: int = 5,
    relevance_threshold: float | None = None,
    max_users: int | None = None,
) -> DataFrame:
    """Users to evaluate: known from train, with relevant test items and enough distinct train items.

    Keeps both the number of relevant rows (recall) and of distinct relevant items (NDCG).
    """
    rel = relevant_rows(test, relevance_threshold)
    per_item = rel.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("c"))
    per_user = per_item.groupBy("user_id").agg(
        F.sum("c").alias("n_rel_rows"), F.count(F.lit(1)).alias("n_rel_items")
    )
    users = per_user.join(
        history_sizes(history(train)).filter(F.col("n_train") >= max(min_train_ratings, 1)),
        "user_id",
    )
    if max_users:
        users = users.orderBy("user_id").limit(max_users)
    return users


def list_metrics(
    rankings: DataFrame, users: DataFrame, test: DataFrame, top_n: int = 10,
    relevance_threshold: float | None = None,
) -> DataFrame:
    """Hits, precision, recall and NDCG of each evaluation user (users without a list score 0)."""
    recs = rankings.filter(F.col("rank") <= top_n).select("user_id", "item_id", "rank")
    rel = relevant_rows(test, relevance_threshold).distinct()
    hits = (
        recs.join(rel, ["user_id", "item_id"])
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.sum(rank_discount("rank")).alias("dcg"),
        )
    )
    n = F.coalesce("hits", F.lit(0).cast("long"))
    ideal = ideal_dcg("n_rel_items", top_n)
    return users.join(hits, "user_id", "left").select(
        *users.columns,
        n.alias("hits"),
        (n / F.lit(float(top_n)) if top_n > 0 else F.lit(0.0)).alias("precision"),
        (n / F.col("n_rel_rows")).alias("recall"),
        F.when(ideal > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def accuracy_summary(per_user: DataFrame) -> DataFrame:
    """Macro averages; the F-measure is taken from the averaged precision and recall."""
    return per_user.agg(
        mean_or_zero("precision").alias("Precision"),
        mean_or_zero("recall").alias("Recall"),
        mean_or_zero("ndcg").alias("NDCG"),
        F.count(F.lit(1)).alias("n_users_eval"),
    ).select(
        "Precision",
        "Recall",
        f_measure("Precision", "Recall").alias("F-measure"),
        "NDCG",
        "n_users_eval",
    )


def evaluate_recommendations(
    rankings: DataFrame,
    train: DataFrame,
    test: DataFrame,
    top_n: int = 10,
    min_train_ratings: int = 5,
    relevance_threshold: float | None = None,
) -> DataFrame:
    users = evaluation_users(train, test, min_train_ratings, relevance_threshold)
    return accuracy_summary(list_metrics(rankings, users, test, top_n, relevance_threshold))


def evaluate_per_user(
    rankings: DataFrame,
    train: DataFrame,
    test: DataFrame,
    top_n: int = 10,
    min_train_ratings: int = 5,
    relevance_threshold: float | None = None,
    max_users: int | None = None,
) -> DataFrame:
    """One row per evaluation user, with list popularity and the coverage of all their lists."""
    users = evaluation_users(train, test, min_train_ratings, relevance_threshold, max_users)
    base = list_metrics(rankings, users, test, top_n, relevance_threshold)
    recs = (
        rankings.filter(F.col("rank") <= top_n)
        .select("user_id", "item_id")
        .join(users.select("user_id"), "user_id", "left_semi")
    )
    pop = item_popularity(train).select("item_id", "popularity")
    listed = (
        recs.join(pop, "item_id", "left")
        .groupBy("user_id")
        .agg(F.avg(F.coalesce("popularity", F.lit(0.0))).alias("avg_recommended_popularity"))
    )
    coverage = catalogue_coverage(recs, train)
    rows = base.join(listed, "user_id", "left").select(
        F.col("user_id").alias("user"),
        "n_train",
        "precision",
        "recall",
        "ndcg",
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.coalesce("avg_recommended_popularity", F.lit(0.0)).alias("avg_recommended_popularity"),
    )
    return with_scalars(rows, coverage)


def catalogue_coverage(recs: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct recommended items over distinct train items, one row."""
    n_items = train.agg(F.count_distinct("item_id").alias("_n_items"))
    covered = recs.agg(F.count_distinct("item_id").alias("_covered"))
    return with_scalars(covered, n_items).select(
        F.when(F.col("_n_items") > 0, F.col("_covered") / F.col("_n_items"))
        .otherwise(0.0)
        .alias("catalog_coverage")
    )


def candidate_hit_rate(
    candidates: DataFrame,
    train: DataFrame,
    test: DataFrame,
    min_train_ratings: int = 5,
    relevance_threshold: float | None = None,
    max_users: int | None = None,
) -> DataFrame:
    """Share of relevant test rows whose item is among the user's candidates."""
    users = evaluation_users(train, test, min_train_ratings, relevance_threshold, max_users)
    rows = relevant_rows(test, relevance_threshold).join(
        users.select("user_id"), "user_id", "left_semi"
    )
    found = rows.join(
        candidates.select("user_id", "item_id", F.lit(1.0).alias("hit")),
        ["user_id", "item_id"],
        "left",
    )
    return found.agg(
        mean_or_zero(F.coalesce("hit", F.lit(0.0))).alias("candidate_hit_rate"),
        F.count(F.lit(1)).alias("n_test_rows"),
    )
