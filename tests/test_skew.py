"""Heavy keys take other routes than light ones and must give the same rows."""

import pytest
from pyspark.sql import Window as W, functions as F

from tables import table
from recspark.metrics import beyond
from recspark.models.item_cf import ItemCF
from recspark.operators import candidates, explain, negatives, pairs, split, stats, supports, topk
from recspark.skew import durable, global_position, ranked_in_group

LIMIT = 8  # three users of the fixture are heavy


def test_ranked_in_group(spark):
    df = spark.range(500).select(
        F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7).alias("k"),
        F.md5(F.col("id").cast("string")).alias("h"),
    )
    got = ranked_in_group(df, "k", [F.col("h")], F.substring("h", 1, 1), "r", "n", limit=50)
    w = W.partitionBy("k")
    want = df.withColumn("r", F.row_number().over(w.orderBy("h"))).withColumn(
        "n", F.count(F.lit(1)).over(w))
    assert table(got, "k", "h", "r", "n") == table(want, "k", "h", "r", "n")


def test_global_position(spark):
    df = spark.range(300).select((F.col("id") * 37 % 300).alias("x"))
    got = global_position(df, [F.col("x").desc()], "pos", limit=10)
    assert table(got, "x", "pos") == sorted(((299 - p + 1, p) for p in range(1, 301)), key=str)


def test_stored_tables_that_compress_well_are_not_broadcast(spark, capsys):
    """Their files stay below the threshold of broadcasts however many rows they hold."""
    lists = spark.range(40_000).select(
        (F.col("id") % 4).alias("user_id"), (F.col("id") % 10).alias("item_id"))
    items = spark.range(20_000_000).select(F.col("id").alias("item_id"))

    def plan(stored):
        joined = items.join(stored.filter(F.col("user_id") > 1).select("item_id"), "item_id")
        capsys.readouterr()
        joined.explain()
        return capsys.readouterr().out

    assert "BroadcastHashJoin" in plan(durable(lists))
    assert "BroadcastHashJoin" not in plan(durable(lists, max_broadcast_rows=39_999))
    assert table(durable(lists, 39_999), "user_id", "item_id") == table(
        durable(lists), "user_id", "item_id")


def test_positions_of_a_large_table_are_not_broadcast(spark, capsys):
    df = spark.range(300).select("id")
    placed = global_position(df, [F.col("id")], "pos", limit=10)
    capsys.readouterr()
    spark.range(20_000_000).join(placed, "id").explain()
    assert "SortMergeJoin" in capsys.readouterr().out


def test_sorts_of_lists_are_not_merged_by_compressed_size(spark):
    lists = spark.range(6000).select(
        F.floor(F.col("id") / 3).alias("user_id"), (F.col("id") % 3).alias("item_id"),
        (F.col("id") % 3 + 1).alias("rank"), F.lit(1.0).alias("score"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    following = explain.with_next(lists)
    assert following.rdd.getNumPartitions() == tasks
    assert {r["next_item"] for r in following.filter("rank = 1").collect()} == {1}
    free = topk.first_free_positions(
        lists.select("user_id").distinct().withColumn("need", F.lit(2)),
        lists.select("user_id", F.col("rank").alias("pos")).filter("pos < 3"), "need")
    assert free.rdd.getNumPartitions() == tasks
    assert table(free.select("pos", "rank").distinct(), "pos", "rank") == [(3, 1), (4, 2)]


def test_split_of_oversized_users(skewed):
    keyed = skewed.withColumn("row_key", split.split_key(1, "row_key"))
    a = split.split_per_user(keyed, 0.8)
    b = split.split_per_user(keyed, 0.8, max_group_rows=5)
    assert table(a, "row_key", "split") == table(b, "row_key", "split")
    n = {r["user_id"]: r["n"] for r in keyed.groupBy("user_id").agg(
        F.count("*").alias("n")).collect()}
    got = {r["user_id"]: r["t"] for r in a.groupBy("user_id").agg(
        F.count_if(F.col("split") == "train").alias("t")).collect()}
    assert got == {u: int(c * 0.8) for u, c in n.items()}


def test_pair_overlap_with_heavy_users(spark, skewed):
    hist = stats.history(skewed)
    want = table(pairs.item_pair_overlap(hist), "item_a", "item_b", "n_users")
    assert table(pairs.item_pair_overlap(hist, LIMIT), "item_a", "item_b", "n_users") == want
    asked = spark.createDataFrame([(0, 1), (3, 20), (5, 29), (98, 99)], "item_a long, item_b long")
    known = {(a, b): n for a, b, n in want}
    got = table(pairs.pair_overlap(asked, pairs.split_history(hist, LIMIT)),
                "item_a", "item_b", "n_users")
    assert got == sorted(((a, b, known.get((a, b), 0)) for a, b in
                          [(0, 1), (3, 20), (5, 29), (98, 99)]), key=str)


def _recs(skewed):
    """Every unseen item of ten users, two of them heavy."""
    users = skewed.select("user_id").distinct().filter("user_id in (0,1,5,8,11,17,23,30,36,39)")
    items = skewed.select("item_id").distinct()
    seen = stats.history(skewed)
    return users.crossJoin(items).join(seen, ["user_id", "item_id"], "left_anti")


def test_supports_with_heavy_users(skewed):
    recs = _recs(skewed)
    light = supports.ItemSimilarity.fit(skewed)
    heavy = supports.ItemSimilarity.fit(skewed, LIMIT)
    assert light.hist.heavy is None and heavy.hist.heavy is not None
    for operator in (supports.history_supports, supports.similar_item_supports):
        a, b = operator(recs, light), operator(recs, heavy)
        cols = ["user_id", "item_id", "rank", "support_item", "user_overlap", "user_union",
                "similarity", "avg_rating"]
        assert table(a, *cols) == table(b, *cols)


def test_similar_items_by_brute_force(skewed):
    rows = [(r["user_id"], r["item_id"]) for r in stats.history(skewed).collect()]
    mean = {r["item_id"]: r["avg_rating"] for r in stats.item_stats(skewed).collect()}
    raters, seen = {}, {}
    for u, i in rows:
        raters.setdefault(i, set()).add(u)
        seen.setdefault(u, set()).add(i)
    want = []
    recs = _recs(skewed)
    for r in recs.collect():
        found = []
        for j in raters:
            c = len(raters[r["item_id"]] & raters[j])
            if j != r["item_id"] and j not in seen[r["user_id"]] and c:
                s = c / len(raters[r["item_id"]] | raters[j])
                found.append((-s, -c, -mean[j], j))
        want += [(r["user_id"], r["item_id"], k, f[3]) for k, f in enumerate(sorted(found)[:3], 1)]
    got = supports.similar_item_supports(recs, supports.ItemSimilarity.fit(skewed, LIMIT))
    assert table(got, "user_id", "item_id", "rank", "support_item") == sorted(want, key=str)


@pytest.mark.parametrize("cap", [3, 12, 100])
def test_candidates_with_heavy_users(skewed, cap):
    users = skewed.select("user_id").distinct()
    cols = ["user_id", "item_id", "cand_rank", "source"]
    a = candidates.candidate_items(users, skewed, cap)
    b = candidates.candidate_items(users, skewed, cap, limit=LIMIT)
    assert table(a, *cols) == table(b, *cols)


def test_item_cf_with_heavy_users(skewed):
    a, b = ItemCF.fit(skewed, k=5), ItemCF.fit(skewed, k=5, limit=LIMIT)
    assert b.hist.heavy is not None
    assert table(a.similarities(), "item_a", "item_b", "sim") == table(
        b.similarities(), "item_a", "item_b", "sim")
    asked = _recs(skewed)
    assert table(a.predict(asked)) == table(b.predict(asked))
    users = skewed.select("user_id").distinct()
    assert table(a.rank(users, 6)) == table(b.rank(users, 6))


def test_item_cf_list_is_the_best_of_all_predictions(skewed):
    model = ItemCF.fit(skewed, k=5)
    asked = _recs(skewed)
    best = {}
    for u, i, p in table(model.predict(asked), "user_id", "item_id", "prediction"):
        best.setdefault(u, []).append((-p, i))
    want = [(u, i, k) for u, rows in best.items() for k, (_, i) in enumerate(sorted(rows)[:4], 1)]
    got = model.rank(asked.select("user_id").distinct(), 4)
    assert table(got, "user_id", "item_id", "rank") == sorted(want, key=str)


def test_diversity_with_heavy_users(skewed):
    recs = stats.history(skewed).withColumn("rank", F.row_number().over(
        W.partitionBy("user_id").orderBy("item_id"))).filter("rank <= 4")
    assert table(beyond.list_diversity(recs, skewed)) == table(
        beyond.list_diversity(recs, skewed, LIMIT))


def test_negatives_are_never_positives(spark, skewed):
    pos = stats.history(skewed.filter("rating >= 4"))
    index = split.id_index(skewed, "item_id", "item_idx")
    uniform = negatives.sample_negatives(pos, index, tries=20)
    walked = negatives.sample_negatives(
        pos, index, "cooccurrence", hist=stats.history(skewed), tries=4, uniform_tries=50)
    for drawn in (uniform, walked):
        hits = drawn.join(pos.withColumnRenamed("item_id", "neg_item_id"),
                          ["user_id", "neg_item_id"], "left_semi")
        assert hits.count() == 0
        assert drawn.count() == pos.count()


def test_a_grown_index_keeps_its_numbers(spark, skewed):
    first = skewed.filter("item_id % 3 = 0")
    index = split.id_index(first, "item_id", "item_idx")
    whole = split.grow_index(index, skewed, "item_id", "item_idx")
    old, new = (dict(table(x, "item_id", "item_idx")) for x in (index, whole))
    assert {k: new[k] for k in old} == old
    later = sorted(k for k in new if k not in old)
    assert [new[k] for k in later] == list(range(len(old), len(new)))
    assert set(new) == {r["item_id"] for r in skewed.collect()}
    again = split.grow_index(whole, first, "item_id", "item_idx")
    assert dict(table(again, "item_id", "item_idx")) == new
    empty = index.filter("item_idx < 0")
    assert dict(table(split.grow_index(empty, first, "item_id", "item_idx"))) == old
    assert [f.dataType.typeName() for f in whole.schema.fields if f.name == "item_idx"] == ["long"]


def test_an_item_of_all_busy_users_makes_no_long_row(spark):
    """Two items rated by 1,300 busy users each, 900 of them common: three rows of one size each."""
    rows = [(u, i) for u in range(1300) for i in (1, 100 + u % 7, 200 + u % 5)]
    rows += [(u, 2) for u in range(400, 1700)] + [(u, 300 + u % 3) for u in range(1300, 1700)]
    hist = spark.createDataFrame(rows, "user_id long, item_id long")
    h = pairs.split_history(hist, 1)
    bits = h.heavy_bitmaps()
    assert bits.filter("item_id = 1").count() == 3
    assert {r[0] for r in bits.select(F.size("bits")).collect()} == {pairs.BUCKET_WORDS}
    asked = spark.createDataFrame([(1, 2), (1, 300), (2, 100)], "item_a long, item_b long")
    want = {}
    raters = {}
    for u, i in rows:
        raters.setdefault(i, set()).add(u)
    for a, b in ((1, 2), (1, 300), (2, 100)):
        want[a, b] = len(raters[a] & raters[b])
    got = {(r["item_a"], r["item_b"]): r["n_users"] for r in pairs.pair_overlap(asked, h).collect()}
    assert got == want
    whole = {(r["item_a"], r["item_b"]): r["n_users"]
             for r in pairs.item_pair_overlap(hist, 1).collect()}
    assert whole == {(a, b): n for a in raters for b in raters
                     if a < b and (n := len(raters[a] & raters[b]))}
