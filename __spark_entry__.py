"""Registered queries and the SQL they are checked against.

Interactions come from order lines, reviews from documents (``recspark.sources.views``). The split
and the popularity rankings many queries start from are stored once per session and input folder,
as a production run would store them after preprocessing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from importlib import import_module
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from recspark.functions.scores import damped, dot, hinge_loss, log_sigmoid_loss
from recspark.metrics import beyond, cold_start, explanation, fairness, late_fusion, list_audit, \
    rating, topn
from recspark.models import pairwise
from recspark.models.hybrid import ContentHybrid
from recspark.models.implicit_als import ImplicitALS
from recspark.models.item_cf import ItemCF
from recspark.models.latent import rank_by_dot
from recspark.models.mf import MatrixFactorization
from recspark.models.popularity import Popularity
from recspark.operators import candidates, explain, negatives, pairs, rerank, split, stats, \
    supports, textprofiles, topk
from recspark.plans import experiment, explain_view
from recspark.skew import checkpoint_dir, durable
from recspark.sources import artifacts, reviews as review_files, tracking, views

from recspark_oracle import ORACLE_SQL, STOP_WORDS

TOP_N = 10
POOL = 80
THRESHOLD = 4.0
VOCABULARY = 3500
CANDIDATE_CAP = 500

_STORED: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "split",
        lambda: durable(split.split_per_user(views.interactions(spark, sf_dir)), codec="zstd"),
    )


def _train(spark, d) -> DataFrame:
    return split.train_part(_split(spark, d))


def _test(spark, d) -> DataFrame:
    return split.test_part(_split(spark, d))


def _users(spark, d) -> DataFrame:
    return _train(spark, d).select("user_id").distinct()


def _popularity(spark, d) -> Popularity:
    return _once(spark, d, "popularity", lambda: Popularity.fit(_train(spark, d)))


def _pop_lists(spark, d) -> DataFrame:
    return _once(
        spark, d, "pop_lists",
        lambda: durable(_popularity(spark, d).rank(_users(spark, d), TOP_N + 5)),
    )


def _recs(spark, d) -> DataFrame:
    return topk.recommend(_pop_lists(spark, d), TOP_N)


def _similarity(spark, d) -> supports.ItemSimilarity:
    return _once(spark, d, "similarity", lambda: supports.ItemSimilarity.fit(_train(spark, d)))


def _explained(spark, d) -> DataFrame:
    return _once(
        spark, d, "explained",
        lambda: durable(explain.explain(_recs(spark, d), _similarity(spark, d))),
    )


def _per_user(spark, d) -> DataFrame:
    return _once(
        spark, d, "per_user",
        lambda: durable(topn.evaluate_per_user(
            _recs(spark, d), _train(spark, d), _test(spark, d), TOP_N, 5, THRESHOLD)),
    )


def _item_cf(spark, d) -> ItemCF:
    return _once(spark, d, "item_cf", lambda: ItemCF.fit(_train(spark, d)))


def _reviews(spark, d) -> DataFrame:
    return views.reviews(spark, d)


def _text(spark, d) -> textprofiles.TextProfiles:
    return _once(
        spark, d, "text",
        lambda: textprofiles.TextProfiles.fit(
            _reviews(spark, d), max_features=VOCABULARY, stop_words=STOP_WORDS),
    )


def _review_pool(spark, d) -> DataFrame:
    def build():
        rv = _reviews(spark, d).select("user_id", "item_id", "rating", "row_key")
        return durable(Popularity.fit(rv).rank(rv.select("user_id").distinct(), POOL))

    return _once(spark, d, "review_pool", build)


def _r(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    """Round compared columns; all other columns pass through."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return _r(df, *[n for n, t in df.dtypes if t == "double"], digits=digits)


# -- data preparation ---------------------------------------------------------------------------


def q_train_test_split(spark, d):
    return _split(spark, d).select("user_id", "item_id", "rating", "row_key", "split")


def q_split_partition_check(spark, d):
    s = _split(spark, d)
    whole = views.interactions(spark, d)
    parts = s.select(*whole.columns)
    lost = whole.exceptAll(parts).agg(F.count(F.lit(1)).alias("lost_rows"))
    added = parts.exceptAll(whole).agg(F.count(F.lit(1)).alias("added_rows"))
    sizes = split.dataset_sizes(_train(spark, d), _test(spark, d))
    return stats.with_scalars(stats.with_scalars(sizes, lost), added)


def q_jsonl_audit(spark, d):
    """Write the reviews as a raw review file, damaged on purpose, and audit it."""
    rv = _reviews(spark, d)
    line = F.to_json(
        F.struct(
            F.when(F.col("row_key") % 11 != 0, F.col("user_id").cast("string"))
            .alias("reviewerID"),
            F.col("item_id").cast("string").alias("asin"),
            F.when(F.col("row_key") % 7 == 0, F.lit("9.0"))
            .otherwise(F.col("rating").cast("string")).alias("overall"),
            "summary", "reviewText", "verified", "style",
        )
    )
    text = F.when(F.col("row_key") % 13 == 0, F.lit("{broken")).otherwise(line)
    path = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    rv.select(text.alias("value")).write.mode("overwrite").text(path)
    audit = review_files.audit_jsonl(spark, path)
    loaded = review_files.load_reviews(spark, path).agg(
        F.count(F.lit(1)).alias("loaded_rows"), F.sum("rating").alias("loaded_rating_sum")
    )
    return stats.with_scalars(audit, loaded)


def q_split_sink(spark, d):
    """The split, written as partitions and read back."""
    path = f"{checkpoint_dir(spark)}/split-{uuid.uuid4().hex}"
    review_files.write_split(_split(spark, d), path)
    return spark.read.parquet(path).select("user_id", "item_id", "rating", "row_key", "split")


def q_subset_sink(spark, d):
    """Train rows of the eligible users, written as JSON lines and read back strictly."""
    path = f"{checkpoint_dir(spark)}/subset-{uuid.uuid4().hex}"
    keep = split.eligible_users(_train(spark, d), _test(spark, d), 20, 5)
    rows = _train(spark, d).select(
        F.col("user_id").cast("string"), F.col("item_id").cast("string"), "rating")
    written = review_files.write_user_subset(
        rows, keep.select(F.col("user_id").cast("string")), path)
    return review_files.load_prepared(spark, path).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum"),
    ).withColumn("rows_written", F.lit(written).cast("long"))


def q_reviewer_names(spark, d):
    """Names from a raw review file in which some lines have none."""
    path = f"{checkpoint_dir(spark)}/names-{uuid.uuid4().hex}"
    name = F.when(F.col("row_key") % 3 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" Reader "), F.col("user_id").cast("string")))
    line = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("reviewerID"),
        F.col("item_id").cast("string").alias("asin"), name.alias("reviewerName")))
    _reviews(spark, d).select(line.alias("value")).write.text(path)
    return review_files.reviewer_names(review_files.load_raw(spark, path))


def q_stored_model(spark, d):
    """A fitted model written, found again instead of fitted, and compared: vectors and changes."""
    root = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    als = _als(spark, d)
    artifacts.fit_or_load(spark, ImplicitALS, lambda: als, root, "run", "Implicit ALS")
    again = artifacts.fit_or_load(spark, ImplicitALS, None, root, "run", "Implicit ALS")

    def changed(name: str, key: str) -> DataFrame:
        a, b = getattr(als, name), getattr(again, name)
        both = a.join(b.withColumnRenamed("features", "other"), key, "full")
        return both.agg(
            F.lit(name).alias("vectors"), F.count(F.lit(1)).alias("n"),
            F.count_if(~F.col("features").eqNullSafe(F.col("other"))).alias("changed"))

    return changed("user_factors", "user_id").unionByName(changed("item_factors", "item_id"))


def q_stored_versions(spark, d):
    """A model stored twice, and once more by a writer that stops between two tables: the versions
    there are, and whether the latest complete one is read."""
    root = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    train = _train(spark, d)
    place = (root, "run", "Popularity")
    artifacts.save_model(Popularity.fit(_test(spark, d)), *place)
    whole = Popularity.fit(train)
    artifacts.save_model(whole, *place)

    class Stopped(Popularity):
        def tables(self):
            broken = self.seen.select(F.raise_error(F.lit("stopped")).cast("string").alias("x"))
            return {"order": self.order, "seen": broken}

    try:
        artifacts.save_model(Stopped.fit(_test(spark, d)), *place)
    except Exception as err:  # the planned stop, and nothing else
        if "stopped" not in str(err):
            raise
    again = artifacts.load_model(spark, Popularity, *place)
    versions = artifacts.model_versions(spark, *place).agg(F.count(F.lit(1)).alias("versions"))
    same = again.order.select("item_id", "n_ratings").join(
        whole.order.select("item_id", F.col("n_ratings").alias("n")), "item_id", "full")
    return versions.crossJoin(same.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(~F.col("n_ratings").eqNullSafe(F.col("n"))).alias("changed")))


def q_grown_index(spark, d):
    """The index of the best rated items, grown by all others: old numbers stay, new ones follow."""
    train = _train(spark, d)
    known = split.id_index(train.filter(F.col("rating") >= 5.0), "item_id", "item_idx")
    return split.grow_index(known, train, "item_id", "item_idx")


def q_eligible_users(spark, d):
    return split.eligible_users(_train(spark, d), _test(spark, d), 20, 5)


def q_small_dataset_sizes(spark, d):
    tr, te = split.small_dataset(
        _train(spark, d), _test(spark, d), min_train_ratings=20, min_test_ratings=5)
    return split.dataset_sizes(tr, te)


def q_id_index(spark, d):
    return split.id_index(_train(spark, d), "item_id", "item_idx").select(
        "item_id", F.col("item_idx").cast("long").alias("item_idx"))


def q_dataset_profile(spark, d):
    return _rounded(stats.dataset_profile(views.interactions(spark, d)))


def q_user_profiles(spark, d):
    best = F.array_join(
        F.transform("best_rated", lambda b: F.concat_ws(
            ":", b["item_id"].cast("string"), b["rating"].cast("int").cast("string"))), " ")
    return _r(stats.user_profiles(_train(spark, d)), "avg_rating").select(
        "user_id", "n_rated", "avg_rating", best.alias("best_rated"))


def q_item_titles(spark, d):
    return review_files.item_titles(views.item_catalogue(spark, d))


def q_display_labels(spark, d):
    titles = review_files.item_titles(views.item_catalogue(spark, d))
    shown = review_files.display_titles(
        titles, review_files.fallback_titles(_reviews(spark, d), "row_key"))
    return review_files.display_labels(
        _popularity(spark, d).popular_items(20), shown, "item_id", "title", "label"
    ).select("item_id", "label", "num_ratings")


# -- statistics ----------------------------------------------------------------------------------


def q_item_stats(spark, d):
    tr = _train(spark, d)
    joined = stats.item_stats(tr).join(
        stats.item_popularity(tr).select("item_id", "popularity"), "item_id")
    return _r(joined, "avg_rating", "popularity")


def q_rating_biases(spark, d):
    _, u, i = stats.biases(_train(spark, d))
    both = u.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"),
                    F.col("user_bias").alias("bias")).unionByName(
        i.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"),
                 F.col("item_bias").alias("bias")))
    return _r(both, "bias")


def q_rating_residuals(spark, d):
    return _r(stats.residuals(_train(spark, d)), "residual").select(
        "row_key", "user_id", "item_id", "residual")


def q_item_pair_overlap(spark, d):
    tr = _train(spark, d)
    hist = stats.history(tr)
    n = stats.rater_counts(hist)
    return _r(
        pairs.item_pair_overlap(hist)
        .join(n.select(F.col("item_id").alias("item_a"), F.col("n_raters").alias("n_a")), "item_a")
        .join(n.select(F.col("item_id").alias("item_b"), F.col("n_raters").alias("n_b")), "item_b")
        .withColumn("jaccard", pairs.jaccard("n_users", "n_a", "n_b"))
        .select("item_a", "item_b", "n_users", "jaccard"),
        "jaccard",
    )


# -- popularity ----------------------------------------------------------------------------------


def q_popular_items(spark, d):
    return _r(_popularity(spark, d).popular_items(20), "avg_rating")


def q_popularity_predictions(spark, d):
    p = _popularity(spark, d).predict(_test(spark, d))
    return _r(p, "prediction").select("row_key", "user_id", "item_id", "prediction")


def q_popularity_rating_eval(spark, d):
    return _rounded(rating.evaluate_rating_prediction(_popularity(spark, d), _test(spark, d)))


def q_popularity_top_n(spark, d):
    return _recs(spark, d).select("user_id", "item_id", "rank", "score", "score_source")


def q_topn_eval(spark, d):
    return _rounded(topn.evaluate_recommendations(
        _recs(spark, d), _train(spark, d), _test(spark, d), TOP_N, 5, THRESHOLD
    ).withColumnRenamed("F-measure", "F_measure"))


def q_topn_eval_all_relevant(spark, d):
    return _rounded(topn.evaluate_recommendations(
        _recs(spark, d), _train(spark, d), _test(spark, d), TOP_N, 5, None
    ).withColumnRenamed("F-measure", "F_measure"))


def q_per_user_eval(spark, d):
    return _rounded(_per_user(spark, d))


# -- candidates and item CF ------------------------------------------------------------------------


def _candidates(spark, d):
    return _once(
        spark, d, "candidates",
        lambda: durable(candidates.candidate_items(
            _users(spark, d), _train(spark, d), CANDIDATE_CAP, 20)),
    )


def q_candidate_items(spark, d):
    return _candidates(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col("source") == "popular").alias("n_popular"),
        F.sum(F.col("item_id") * F.col("cand_rank")).alias("checksum"),
    )


def _excluded(spark, d):
    """Pairs left out of rankings on top of what was seen, some among the most popular items."""
    best = stats.popularity_order(stats.item_stats(_train(spark, d))).filter(F.col("pos") <= 40)
    return _users(spark, d).join(
        F.broadcast(best.select("item_id")),  # 40 rows
        (F.col("user_id") + F.col("item_id")) % 3 == 0)


def q_candidate_items_excluding(spark, d):
    found = candidates.candidate_items(
        _users(spark, d), _train(spark, d), 50, 20, _excluded(spark, d))
    return found.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col("source") == "popular").alias("n_popular"),
        F.sum(F.col("item_id") * F.col("cand_rank")).alias("checksum"),
    )


def q_popularity_top_n_excluding(spark, d):
    lists = _popularity(spark, d).rank(_users(spark, d), TOP_N, _excluded(spark, d))
    return lists.select("user_id", "item_id", "rank", "score")


def q_item_cf_top_n_excluding(spark, d):
    lists = _item_cf(spark, d).rank(_users(spark, d), TOP_N, _excluded(spark, d))
    return _r(lists, "score", digits=6).select("user_id", "item_id", "rank", "score")


def q_candidate_hit_rate(spark, d):
    """Of all candidates: how many relevant test items are rated often enough and were not seen."""
    every = candidates.candidate_items(
        _users(spark, d), _train(spark, d), _item_index(spark, d).count(), 20)
    return _rounded(topn.candidate_hit_rate(
        every, _train(spark, d), _test(spark, d), 5, THRESHOLD, None))


def q_item_cf_similarity(spark, d):
    return _r(_item_cf(spark, d).similarities(), "sim", digits=6)


def q_item_cf_predictions(spark, d):
    p = _item_cf(spark, d).predict(_test(spark, d))
    return _r(p, "prediction", digits=6).select("row_key", "user_id", "item_id", "prediction")


def q_item_cf_rating_eval(spark, d):
    return _rounded(rating.evaluate_rating_prediction(_item_cf(spark, d), _test(spark, d)), 6)


def _item_cf_lists(spark, d):
    return _once(spark, d, "item_cf_lists",
                 lambda: durable(_item_cf(spark, d).rank(_users(spark, d), TOP_N)))


def q_item_cf_top_n(spark, d):
    return _r(_item_cf_lists(spark, d), "score", digits=6).select(
        "user_id", "item_id", "rank", "score")


# -- beyond accuracy, fairness, cold start ----------------------------------------------------------


def q_list_diversity(spark, d):
    return _rounded(beyond.list_diversity(_recs(spark, d), _train(spark, d)))


def q_list_novelty(spark, d):
    return _rounded(beyond.list_novelty(
        _recs(spark, d), stats.item_popularity(_train(spark, d))))


def q_beyond_accuracy(spark, d):
    return _rounded(beyond.evaluate_beyond_accuracy(
        _recs(spark, d), _train(spark, d), _test(spark, d), TOP_N, 5, THRESHOLD))


def q_activity_summary(spark, d):
    return _rounded(fairness.summarize_by_activity(_per_user(spark, d), 4))


def q_disparity_ratios(spark, d):
    summary = fairness.summarize_by_activity(_per_user(spark, d), 4)
    return _rounded(stats.with_scalars(
        fairness.disparity_ratios(summary), fairness.ndcg_max_min_ratio(summary)), 6)


def q_cold_warm_gap(spark, d):
    return _rounded(fairness.cold_warm_gap(_per_user(spark, d), 15, 40))


def q_fairness_metrics(spark, d):
    return _rounded(fairness.fairness_metrics(_per_user(spark, d), 4, 15, 40), 6)


def _cold_start(lists, spark, d):
    return cold_start.cold_start_benchmark(
        lists, _train(spark, d), _test(spark, d), TOP_N, 1, THRESHOLD, None, 15, 40)


def q_cold_start_benchmark(spark, d):
    return _rounded(_cold_start(_recs(spark, d), spark, d))


def q_cold_start_comparison(spark, d):
    base = _cold_start(_recs(spark, d), spark, d)
    other = _cold_start(_adjusted(spark, d), spark, d)
    return _rounded(cold_start.compare_cold_start(base, other, "adjusted_vs_base"))


# -- explanations ------------------------------------------------------------------------------------


def _support_rows(df):
    return _r(df, "similarity", "avg_rating").select(
        "user_id", "item_id", "rank", "support_item", "user_overlap", "user_union", "similarity",
        "avg_rating")


def q_history_supports(spark, d):
    return _support_rows(supports.history_supports(_recs(spark, d), _similarity(spark, d)))


def q_similar_item_supports(spark, d):
    return _support_rows(supports.similar_item_supports(_recs(spark, d), _similarity(spark, d)))


def q_explanations(spark, d):
    return _r(_explained(spark, d), "support_confidence").select(
        "user_id", "recommended_item", "explanation_type", "explanation_text",
        "support_confidence", F.size("supporting_history").alias("n_history"),
        F.size("supporting_similar_items").alias("n_similar"))


def _counterfactuals(spark, d):
    return explain.counterfactuals(_explained(spark, d), _eleven(spark, d))


def _eleven(spark, d):
    return topk.recommend(_pop_lists(spark, d), TOP_N + 1)


def q_counterfactuals(spark, d):
    first = F.get("weakening_actions", F.lit(0))
    return _counterfactuals(spark, d).select(
        "user_id", "recommended_item", "current_rank", "current_score", "next_item",
        "next_item_score", "estimated_margin",
        F.size("weakening_actions").alias("n_actions"),
        first["item_id"].alias("first_item"),
        F.round(first["estimated_impact"], 9).alias("first_impact"),
        first["reason"].alias("first_reason"),
        "minimal_change_text", F.round("confidence", 9).alias("confidence"))


def q_next_item_margins(spark, d):
    return explain.with_next(_eleven(spark, d)).select(
        "user_id", "item_id", "rank", "next_item", "next_item_score", "estimated_margin")


def q_explanation_eval(spark, d):
    e = explanation.evaluate_explanations(_explained(spark, d))
    return _rounded(stats.with_scalars(
        e, explanation.evaluate_counterfactuals(_counterfactuals(spark, d))))


def _adjusted(spark, d):
    return _once(
        spark, d, "adjusted",
        lambda: durable(rerank.adjust_scores(
            _eleven(spark, d), _explained(spark, d), stats.item_popularity(_train(spark, d)),
            True, 2.0, 1.0)),
    )


def q_adjusted_rankings(spark, d):
    return _rounded(_adjusted(spark, d)).select(
        "user_id", "item_id", "rank", "base_rank", "raw_model_score", "effective_base_score",
        "effective_base_score_source", "support_confidence", "support_boost",
        "popularity_penalty", "adjusted_score")


def q_explainable_eval(spark, d):
    out = explanation.evaluate_explainable(
        _eleven(spark, d), _train(spark, d), _test(spark, d), TOP_N, 5, THRESHOLD, None, True,
        2.0, 1.0, _similarity(spark, d))
    return _rounded(out.withColumnRenamed("causal_F-measure", "causal_F_measure"))


def q_explain_view(spark, d):
    view = explain_view.explain_rankings(
        _pop_lists(spark, d), _train(spark, d), _similarity(spark, d), TOP_N, 2.0, 1.0)
    return _r(view, "score", "support_confidence", "estimated_margin").select(
        "user_id", "item_id", "rank", "base_rank", "score", "support_confidence",
        "explanation_type", "next_item", "estimated_margin", "minimal_change_text")


# -- text ----------------------------------------------------------------------------------------------


def q_review_snippets(spark, d):
    return textprofiles.snippets(_reviews(spark, d)).select("row_key", "snippet")


def q_item_documents(spark, d):
    return textprofiles.item_documents(_reviews(spark, d)).select(
        "item_id", F.md5("doc").alias("doc_md5"), F.length("doc").alias("doc_len"))


def q_vocabulary(spark, d):
    return _r(_text(spark, d).vocab, "idf").select("term", "df", "corpus_tf", "idf")


def q_tfidf_item_weights(spark, d):
    return _r(_text(spark, d).item_weights, "weight", digits=6)


def _text_scores(spark, d):
    return _once(spark, d, "text_scores",
                 lambda: durable(_text(spark, d).score(_review_pool(spark, d))))


def q_text_similarity(spark, d):
    return _r(_text_scores(spark, d), "text_sim", digits=6)


def q_encoded_similarity(spark, d):
    """Similarity through the encoder hook, with counts of eight letters as the encoder."""
    def letters(text: str):
        return F.array(*[(F.length(text) - F.length(F.replace(F.col(text), F.lit(x), F.lit("")))).cast(
            "double") for x in "aeinorst"])

    model = textprofiles.DenseProfiles.fit(_reviews(spark, d), letters)
    return _r(model.score(_review_pool(spark, d)), "text_sim", digits=6)


def q_late_fusion(spark, d):
    fused = rerank.late_fusion(_review_pool(spark, d), _text_scores(spark, d), 0.7)
    return _r(fused, "fused", "cf_score", "text_sim", digits=6)


def q_late_fusion_eval(spark, d):
    s = _once(spark, d, "review_split", lambda: durable(split.split_per_user(
        _reviews(spark, d).select(
            "user_id", "item_id", "rating",
            split.split_key(42, "row_key").alias("row_key")))))
    tr, te = split.train_part(s), split.test_part(s)
    pool = Popularity.fit(tr).rank(tr.select("user_id").distinct(), POOL)
    out = late_fusion.evaluate_late_fusion(
        durable(pool), _text(spark, d), tr, te, 0.7, top_n=TOP_N, pool_size=POOL,
        relevance_threshold=THRESHOLD)
    return _rounded(out.withColumnRenamed("F-measure", "F_measure"), 6)


def q_content_hybrid(spark, d):
    rv = _reviews(spark, d).select("user_id", "item_id", "rating", "row_key")
    model = ContentHybrid(
        Popularity.fit(rv), _text(spark, d), rv, pool_size=POOL, cold_threshold=21)
    return _r(model.rank(rv.select("user_id").distinct(), TOP_N), "fused", digits=6).select(
        "user_id", "item_id", "rank", "fused")


def q_content_hybrid_unknown(spark, d):
    """The hybrid for users it has never seen: popular items, unfused."""
    rv = _reviews(spark, d).select("user_id", "item_id", "rating", "row_key")
    model = ContentHybrid(Popularity.fit(rv), _text(spark, d), rv, pool_size=POOL)
    users = rv.select((-1 - F.col("user_id")).alias("user_id")).distinct()
    return model.rank(users, TOP_N).select("user_id", "item_id", "rank", "fused")


def q_dense_cosine(spark, d):
    users, items = views.vectors(spark, d)
    pool = users.select(
        F.col("id").alias("user_id"),
        F.explode(F.sequence(F.lit(1), F.lit(19), F.lit(2))).alias("k"),
    ).select("user_id", (F.col("user_id") + F.col("k")).alias("item_id"))
    known = pool.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return _r(textprofiles.DenseProfiles(users, items).score(known), "text_sim", digits=6)


def q_catalogue_top_n(spark, d):
    """Exact Top-N over the embedding catalogue, in whole thousandths, so that scores are whole
    numbers; a user has seen its two neighbours."""
    users, items = views.vectors(spark, d)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double"))
    u = users.select(F.col("id").alias("user_id"), whole.alias("features"))
    i = items.select(F.col("id").alias("item_id"), whole.alias("features"))
    seen = u.select("user_id", F.explode(F.array(
        F.col("user_id") - 1, F.col("user_id") + 1)).alias("item_id"))
    lists = rank_by_dot(u, i, u.select("user_id"), TOP_N, seen, None, "dot")
    return lists.select("user_id", "item_id", "rank", F.col("score").cast("long").alias("score"))


# -- negatives and reporting ----------------------------------------------------------------------------


def _positives(spark, d):
    return stats.history(_train(spark, d).filter(F.col("rating") >= THRESHOLD))


def _item_index(spark, d):
    return _once(spark, d, "item_index",
                 lambda: durable(split.id_index(_train(spark, d), "item_id", "item_idx")))


def q_sample_negatives_uniform(spark, d):
    return negatives.sample_negatives(
        _positives(spark, d), _item_index(spark, d), "first_non_positive", tries=20)


def q_sample_negatives_co_rated(spark, d):
    return negatives.sample_negatives(
        _positives(spark, d), _item_index(spark, d), "cooccurrence",
        hist=stats.history(_train(spark, d)))


def q_pairwise_loss(spark, d):
    drawn = q_sample_negatives_uniform(spark, d)
    pop = stats.item_popularity(_train(spark, d)).select("item_id", "popularity")
    scored = drawn.join(pop.withColumnRenamed("popularity", "pos"), "item_id").join(
        pop.select(F.col("item_id").alias("neg_item_id"), F.col("popularity").alias("neg")),
        "neg_item_id")
    return _rounded(scored.agg(
        F.avg(log_sigmoid_loss("pos", "neg")).alias("bpr_loss"),
        F.avg(hinge_loss("pos", "neg")).alias("hinge_loss"),
        F.count(F.lit(1)).alias("n_pairs")), 6)


def q_results_table(spark, d):
    rows = [
        tracking.metric_rows(
            rating.evaluate_rating_prediction(_popularity(spark, d), _test(spark, d)),
            "run", "Popularity", "rating"),
        tracking.metric_rows(
            topn.evaluate_recommendations(
                _recs(spark, d), _train(spark, d), _test(spark, d), TOP_N, 5, THRESHOLD),
            "run", "Popularity", "ranking"),
        tracking.metric_rows(
            rating.evaluate_rating_prediction(_item_cf(spark, d), _test(spark, d)),
            "run", "Item CF", "rating"),
    ]
    path = f"{checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}"
    rows[0].limit(0).write.mode("overwrite").parquet(path)
    tracking.log_metrics(rows, path)
    table = tracking.results_table(
        spark.read.parquet(path), ["MAE", "RMSE", "Precision", "Recall", "NDCG"])
    return _rounded(table, 6)


# -- learned models ----------------------------------------------------------------------------------------


def _mf(spark, d):
    return _once(spark, d, "mf", lambda: MatrixFactorization.fit(_train(spark, d)))


def q_mf_rating_eval(spark, d):
    return rating.evaluate_rating_prediction(_mf(spark, d), _test(spark, d))


def q_mf_top_n(spark, d):
    return _mf(spark, d).rank(_users(spark, d), TOP_N)


def q_mf_candidate_top_n(spark, d):
    return _mf(spark, d).rank(_users(spark, d), TOP_N, max_candidates=CANDIDATE_CAP)


def _als(spark, d):
    return _once(spark, d, "als", lambda: ImplicitALS.fit(_train(spark, d)))


def q_implicit_als_top_n(spark, d):
    return _als(spark, d).rank(_users(spark, d), TOP_N)


def q_implicit_als_ablation(spark, d):
    drops = supports.history_supports(_recs(spark, d), _similarity(spark, d)).select(
        "user_id", F.col("support_item").alias("item_id")).distinct()
    return _als(spark, d).rank_without(_users(spark, d), drops, TOP_N)


def _pairwise(spark, d, fit: str):
    return _once(spark, d, fit, lambda: getattr(pairwise, fit)(_train(spark, d)))


def q_bpr_top_n(spark, d):
    return _pairwise(spark, d, "fit_bpr").rank(_users(spark, d), TOP_N)


def q_implicit_bpr_top_n(spark, d):
    return _pairwise(spark, d, "fit_implicit_bpr").rank(_users(spark, d), TOP_N)


def q_warp_top_n(spark, d):
    return _pairwise(spark, d, "fit_warp").rank(_users(spark, d), TOP_N)


def _audit(spark, d, model, lists=None, items=None):
    """Whether a model's lists are the best by its factors."""
    return list_audit.audit_lists(
        model.rank(_users(spark, d), TOP_N) if lists is None else lists, model.user_factors,
        model.item_factors if items is None else items, _train(spark, d), TOP_N)


def q_mf_check(spark, d):
    """Lists rank by the damped product, so that is what they are held against."""
    m = _mf(spark, d)
    counts = stats.item_stats(_train(spark, d)).select("item_id", "n_ratings")
    damp = damped(F.lit(1.0), F.col("n_ratings"))
    lists = m.rank(_users(spark, d), TOP_N).join(counts, "item_id").withColumn(
        "score", damped("score", "n_ratings"))
    items = m.item_factors.join(counts, "item_id").select(
        "item_id", F.transform("features", lambda x: x * damp).alias("features"))
    return _audit(spark, d, m, lists, items)


def q_mf_prediction_check(spark, d):
    """Predictions of the held-out pairs, of unknown users and of unknown items, and how many differ
    from the clipped sum of mean, biases and product, or from the mean."""
    m = _mf(spark, d)
    pairs_ = _test(spark, d).select("user_id", "item_id").distinct()
    strange = pairs_.select((-1 - F.col("user_id")).alias("user_id"), "item_id").unionByName(
        pairs_.select("user_id", (-1 - F.col("item_id")).alias("item_id")))
    asked = pairs_.unionByName(strange).distinct()
    mean = m.mean.first()[0]
    known = asked.join(m.user_bias, "user_id").join(m.item_bias, "item_id").join(
        m.user_factors.withColumnRenamed("features", "u"), "user_id").join(
        m.item_factors.withColumnRenamed("features", "i"), "item_id")
    raw = F.lit(mean) + F.col("user_bias") + F.col("item_bias") + F.aggregate(
        F.zip_with("u", "i", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
        lambda t, x: t + x)
    want = known.select("user_id", "item_id", F.when(raw < 1, 1.0).when(raw > 5, 5.0).otherwise(
        raw).alias("want"))
    got = m.predict(asked).join(want, ["user_id", "item_id"], "left")
    off = F.abs(F.col("prediction") - F.coalesce("want", F.lit(mean))) > 1e-9
    return got.agg(F.count(F.lit(1)).alias("pairs"), F.count("want").alias("known_pairs"),
                   F.count_if(F.coalesce(off, F.lit(True))).alias("wrong"))


def _support_items(spark, d):
    return supports.history_supports(_recs(spark, d), _similarity(spark, d)).select(
        "user_id", F.col("support_item").alias("item_id")).distinct()


def q_support_removal_check(spark, d):
    """Every support item of every user taken away by itself, and all of a user's together: removals
    asked, and how many differ from factors solved anew (for the first item, and for all)."""
    m = _als(spark, d)
    mine = durable(_support_items(spark, d).join(
        m.positives().select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"))
    single = mine.select("user_id", F.col("item_id").alias("drop_id"), "item_id")
    every = mine.select("user_id", F.lit(-1).cast("long").alias("drop_id"), "item_id")
    got = durable(m.fold_out(single.unionByName(every)))
    first = mine.groupBy("user_id").agg(F.min("item_id").alias("item_id"))

    def anew(drops):
        left = topk.without(m.positives(), drops).join(
            drops.select("user_id").distinct(), "user_id", "left_semi")
        return m.fold_in(left).withColumnRenamed("features", "want")

    want = anew(first).join(first, "user_id").select(
        "user_id", F.col("item_id").alias("drop_id"), "want").unionByName(
        anew(mine).select("user_id", F.lit(-1).cast("long").alias("drop_id"), "want"))
    gap = F.aggregate(F.zip_with("features", "want", lambda x, y: F.abs(x - y)),
                      F.lit(0.0).cast("float"), lambda t, x: F.greatest(t, x))
    both = want.join(got, ["user_id", "drop_id"], "left")
    asked = mine.agg(F.count(F.lit(1)).alias("removals"), F.count_distinct("user_id").alias("users"))
    return asked.join(both.agg(F.count_if(~F.coalesce(gap < 1e-4, F.lit(False))).alias("differ")),
                      F.lit(True))


def q_score_sources(spark, d):
    """List rows by what their scores say they are."""
    users = _users(spark, d)
    ranked = [Popularity.fit(_train(spark, d)), _mf(spark, d), _als(spark, d)]
    rows = [m.rank(users, TOP_N).select("score_source") for m in ranked]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("score_source").agg(
        F.count(F.lit(1)).alias("list_rows"))


def q_damped_popularity(spark, d):
    """Sums of ratings over the logarithm of their number."""
    item = stats.item_stats(_train(spark, d))
    return item.select("item_id", F.round(damped(
        F.col("avg_rating") * F.col("n_ratings"), F.col("n_ratings")), 9).alias("damped"))


def q_trial_weights(spark, d):
    """Rank weights of the trials for the catalogue of the train rows."""
    n_items = _train(spark, d).select("item_id").distinct().count()
    rows = [(t, w) for t, w in enumerate(pairwise.harmonic_weights(n_items, 20)) if t]
    return _r(spark.createDataFrame(rows, "trial int, weight double"), "weight", digits=9)


def q_implicit_als_check(spark, d):
    return _audit(spark, d, _als(spark, d))


def q_implicit_als_fold_in(spark, d):
    """Users whose factors, solved again from all their positives, miss the trained solution's
    normal equations by more than a thousandth: users asked and users off."""
    m = _als(spark, d)
    again = m.fold_in(m.positives())
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0).cast("float"),
                      lambda s, x: F.greatest(s, x))
    both = again.select("user_id", F.col("features").alias("a")).join(
        m.user_factors.select("user_id", F.col("features").alias("b")), "user_id")
    return both.agg(F.count(F.lit(1)).alias("users"), F.count_if(gap > 0.001).alias("users_off"))


def q_implicit_bpr_check(spark, d):
    return _audit(spark, d, _pairwise(spark, d, "fit_implicit_bpr"))


def q_warp_check(spark, d):
    return _audit(spark, d, _pairwise(spark, d, "fit_warp"))


def q_warp_violator_check(spark, d):
    """The same with the first violating draw as the negative."""
    return _audit(spark, d, pairwise.fit_warp(_train(spark, d), trial_rule="first_violator"))


def q_bpr_check(spark, d):
    return _audit(spark, d, _pairwise(spark, d, "fit_bpr"))


def q_training_gain(spark, d):
    """Whether training at the default settings puts well rated items above drawn unseen ones more
    often than the start vectors do: users asked, and models without a gain."""
    train = _train(spark, d)
    good = train.filter(F.col("rating") >= THRESHOLD).select("user_id", "item_id").distinct()
    index = _item_index(spark, d)
    n = index.count()
    drawn = good.withColumn("item_idx", negatives.draw(
        F.lit(n), "gain", F.col("user_id"), F.col("item_id"))).join(
        index.withColumnRenamed("item_id", "other"), "item_idx")
    drawn = durable(topk.without(
        drawn.select("user_id", F.col("other").alias("item_id"), F.col("item_id").alias("good")),
        train))

    def order(model):
        u = model.user_factors.withColumnRenamed("features", "u")
        i = model.item_factors
        both = drawn.join(u, "user_id").join(i.withColumnRenamed("features", "b"), "item_id").join(
            i.select(F.col("item_id").alias("good"), F.col("features").alias("a")), "good")
        return both.agg(F.avg((dot("u", "a") > dot("u", "b")).cast("int"))).first()[0]

    fits = ("fit_bpr", "fit_implicit_bpr", "fit_warp")
    worse = sum(order(_pairwise(spark, d, fit)) < 0.02 + order(getattr(pairwise, fit)(train, n_epochs=0))
                for fit in fits)
    return good.agg(F.count_distinct("user_id").alias("users"), F.lit(worse).alias("models_without"))


def q_experiment_users(spark, d):
    """How many users the full evaluation of a ranker looks at, by step."""
    rows = experiment.evaluate_ranker(
        "Implicit ALS", _als(spark, d), _train(spark, d), _test(spark, d), "run",
        top_n=TOP_N, relevance_threshold=THRESHOLD)
    return rows.filter(F.col("metric") == "n_explanation_users_eval").select(
        F.col("value").cast("long").alias("users"))


def q_experiment(spark, d):
    return experiment.evaluate_ranker(
        "Implicit ALS", _als(spark, d), _train(spark, d), _test(spark, d), "run",
        top_n=TOP_N, relevance_threshold=THRESHOLD)


def entry(spark: SparkSession) -> DataFrame:
    """Popularity Top-10 with seen items left out, scored against held-out ratings."""
    return q_topn_eval(spark, "/root/testdata/sf0.001")


def _corpus_queries() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators and their pipeline, where they are installed."""
    found, sql = {}, {}
    if find_spec("recspark.llm"):
        operators = import_module("recspark.llm.queries")
        found |= operators.QUERIES
        sql |= import_module("recspark.llm.oracle").ORACLE_SQL
        if find_spec("corpus_pipeline"):
            pipeline = import_module("corpus_pipeline")
            found["pipeline"] = pipeline.run
            if pipeline.ORACLE_SQL:
                sql["pipeline"] = pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
    return own | _corpus_queries()[0]


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | _corpus_queries()[1]
