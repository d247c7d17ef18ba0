"""Items rated by the same users.

Two kinds of users are told apart. A *light* user has at most ``MAX_LIGHT_HISTORY`` items: joining
the history with itself on such users makes at most that many rows per rating. A *heavy* user (at
most ratings / limit of them) never has its items paired with one another. Heavy users are numbered and
dealt to buckets of ``BUCKET_USERS`` instead, every item has one bitmap per bucket with a rater, and
two items share as many of them as their bitmaps have common bits. No row grows with the number of
heavy users of an item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..skew import durable, global_position, oversized_keys

# Lists cut at this number plus a few stay below 1000, up to which the planner cuts them before the
# shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
MAX_LIGHT_HISTORY = 950
# Pairs that a task may group.
PAIRS_OF_TASK = 2_000_000
# Raters of an item whose pairs a task may group.
HOT_RATERS = 100_000
# A bitmap is an array of whole 64-bit words.
BUCKET_WORDS = 8
BUCKET_USERS = 64 * BUCKET_WORDS


@dataclass
class History:
    """Distinct (user_id, item_id) split by user weight. ``heavy`` is None when no user is heavy."""

    all: DataFrame
    light: DataFrame
    heavy: DataFrame | None
    limit: int

    _bitmaps: DataFrame | None = None

    def heavy_bitmaps(self) -> DataFrame:
        """``item_id, bucket, bits``: the heavy users of each item, a row of fixed size per bucket."""
        if self._bitmaps is None:
            numbers = global_position(self.heavy.select("user_id").distinct(), [F.col("user_id")],
                                      "_n", start=0)
            at = F.pmod(F.col("_n"), F.lit(BUCKET_USERS))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
            words = [F.bit_or(F.when(F.floor(at / 64) == k, bit).otherwise(F.lit(0).cast("long")))
                     for k in range(BUCKET_WORDS)]
            self._bitmaps = durable(
                self.heavy.join(numbers, "user_id")
                .withColumn("bucket", F.floor(F.col("_n") / BUCKET_USERS))
                .groupBy("item_id", "bucket").agg(F.array(*words).alias("bits")))
        return self._bitmaps

    def heavy_classes(self) -> DataFrame:
        """``item_id, cls``: items with the same heavy users have the same class, a digest of the set."""
        member = [F.bit_xor(F.xxhash64(F.lit(k), "user_id")) for k in (1, 2)]
        return self.heavy.groupBy("item_id").agg(
            F.concat_ws(":", *[m.cast("string") for m in member],
                        F.count(F.lit(1)).cast("string")).alias("cls"))

    def class_users(self, classes: DataFrame) -> DataFrame:
        """``cls, u``: the heavy users of every class, read from one of its items."""
        one = classes.groupBy("cls").agg(F.min("item_id").alias("item_id"))
        return one.join(self.heavy, "item_id").select("cls", F.col("user_id").alias("u"))


def split_history(hist: DataFrame, limit: int = MAX_LIGHT_HISTORY) -> History:
    big = oversized_keys(hist, "user_id", limit)
    if not big.take(1):
        return History(hist, hist, None, limit)
    return History(
        hist,
        hist.join(big, "user_id", "left_anti"),
        hist.join(big, "user_id", "left_semi"),
        limit,
    )


def _common_bits(a: str, b: str) -> Column:
    words = [F.bit_count(F.col(a)[k].bitwiseAND(F.col(b)[k])) for k in range(BUCKET_WORDS)]
    return sum(words[1:], words[0])


def add_heavy_overlap(pairs: DataFrame, h: History, a: str, b: str, overlap: str) -> DataFrame:
    """Add the heavy users that rated both items to ``overlap``."""
    if h.heavy is None:
        return pairs
    bits = h.heavy_bitmaps()
    left = bits.select(F.col("item_id").alias(a), "bucket", F.col("bits").alias("_ba"))
    right = bits.select(F.col("item_id").alias(b), "bucket", F.col("bits").alias("_bb"))
    shared = (
        pairs.select(a, b).distinct().join(left, a).join(right, [b, "bucket"])
        .groupBy(a, b).agg(F.sum(_common_bits("_ba", "_bb")).alias("_more"))
    )
    return pairs.join(shared, [a, b], "left").withColumn(
        overlap, F.col(overlap) + F.coalesce("_more", F.lit(0).cast("long"))).drop("_more")


def light_partners(light: DataFrame, *values: str) -> DataFrame:
    """Unordered pairs (item_a < item_b) of every user, one row per user and pair, already placed for
    grouping by :func:`pair_keys`; each of ``values`` comes for both items, as ``<value>_a`` and
    ``<value>_b``.

    A rating travels once, with the later items of its user's history as arrays, which takes a few
    bytes a pair; pairs are formed where they are grouped, at most about ``PAIRS_OF_TASK`` in a task.
    Items of many raters, if there are any, are dealt to parts, which follow from the pair (``part``).
    """
    light = light.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    n = light.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    tasks = max(int(light.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                int(n // PAIRS_OF_TASK) + 1)
    hot = oversized_keys(light, "item_id", HOT_RATERS).select(
        "item_id", F.ceil(F.col("group_rows") / HOT_RATERS).cast("int").alias("_parts"))
    entry = F.struct("item_id", *values)
    rows = light.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("_all")).select(
        "_all", F.posexplode("_all").alias("_at", "_own"))
    rows = rows.withColumn("item_a", F.col("_own.item_id"))
    later = F.slice("_all", F.col("_at") + 2, F.size("_all"))
    if hot.take(1):
        rows = rows.join(hot.withColumnRenamed("item_id", "item_a"), "item_a", "left").withColumn(
            "_parts", F.coalesce("_parts", F.lit(1))).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        later = F.filter(later, lambda e: F.pmod(F.xxhash64(e["item_id"]), "_parts") == F.col("part"))
    rows = rows.withColumn("_later", later).filter(F.size("_later") > 0)
    place = [c for c in ("item_a", "part") if c in rows.columns]
    sent = rows.select(
        *place, *[F.col(f"_own.{v}").alias(f"{v}_a") for v in values],
        *[F.col("_later")[c].alias(f"_{c}") for c in ("item_id", *values)],
    ).repartition(tasks, *place)
    zipped = F.inline(F.arrays_zip(*[f"_{c}" for c in ("item_id", *values)]))
    return sent.select(
        *place, *[f"{v}_a" for v in values],
        zipped.alias("item_b", *[f"{v}_b" for v in values]),
    ).filter(F.col("item_a") < F.col("item_b"))


def pair_keys(pairs: DataFrame) -> list[str]:
    """What names a pair of :func:`light_partners`, in the terms its rows are placed by."""
    return [c for c in ("item_a", "part", "item_b") if c in pairs.columns]


def light_pairs(light: DataFrame) -> DataFrame:
    """Unordered pairs (item_a < item_b) with the number of light users who rated both."""
    pairs = light_partners(light)
    return pairs.groupBy(*pair_keys(pairs)).agg(F.count(F.lit(1)).alias("n_users")).drop("part")


def heavy_only_pairs(h: History, known: DataFrame) -> DataFrame:
    """Pairs that only heavy users share: one row per pair of the answer, however many share it.

    Items with the same heavy users form a class; two classes that intersect pair all their items.
    """
    members = h.heavy_classes()
    by_user = h.class_users(members)
    linked = (
        by_user.alias("x")
        .join(by_user.alias("y"), F.col("x.u") == F.col("y.u"))
        .select(F.col("x.cls").alias("cls"), F.col("y.cls").alias("cls_b"))
        .distinct()
    )
    right = members.select(F.col("item_id").alias("item_b"), F.col("cls").alias("cls_b"))
    return (
        members.withColumnRenamed("item_id", "item_a")
        .join(linked, "cls")
        .join(right, "cls_b")
        .filter(F.col("item_a") < F.col("item_b"))
        .select("item_a", "item_b")
        .join(known, ["item_a", "item_b"], "left_anti")
    )


def item_pair_overlap(hist: DataFrame, limit: int = MAX_LIGHT_HISTORY) -> DataFrame:
    """Every pair of items with a common rater and the number of common raters.

    The table is as large as its answer; operators that need some pairs only ask for those
    (:func:`pair_overlap`, :func:`anchored_overlap`).
    """
    h = split_history(hist, limit)
    light = light_pairs(h.light)
    if h.heavy is None:
        return light
    extra = heavy_only_pairs(h, light).withColumn("n_users", F.lit(0).cast("long"))
    return add_heavy_overlap(light.unionByName(extra), h, "item_a", "item_b", "n_users")


def pair_overlap(pairs: DataFrame, h: History) -> DataFrame:
    """Common raters of the given pairs (item_a < item_b), 0 when there are none."""
    pairs = pairs.select("item_a", "item_b").distinct()
    named = pairs.select(F.explode(F.array("item_a", "item_b")).alias("item_id")).distinct()
    counted = light_pairs(h.light.join(named, "item_id", "left_semi"))
    out = pairs.join(counted, ["item_a", "item_b"], "left").withColumn(
        "n_users", F.coalesce("n_users", F.lit(0).cast("long"))
    )
    return add_heavy_overlap(out, h, "item_a", "item_b", "n_users")


def anchored_overlap(anchors: DataFrame, h: History) -> DataFrame:
    """For each anchor item: the other items its light raters rated, with exact overlap."""
    left = h.light.join(anchors.select("item_id").distinct(), "item_id", "left_semi").select(
        "user_id", F.col("item_id").alias("anchor")
    )
    edges = (
        left.join(h.light, "user_id")
        .filter(F.col("anchor") != F.col("item_id"))
        .groupBy("anchor", "item_id")
        .agg(F.count(F.lit(1)).alias("user_overlap"))
    )
    return add_heavy_overlap(edges, h, "anchor", "item_id", "user_overlap")


def jaccard(overlap, n_a, n_b):
    """Shared raters over all raters, by inclusion and exclusion; 0 for two unrated items."""
    union = F.col(n_a) + F.col(n_b) - F.col(overlap)
    return F.when(union > 0, F.col(overlap) / union).otherwise(F.lit(0.0))
