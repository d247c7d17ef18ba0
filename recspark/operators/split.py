"""Per-user split, eligible-user selection and dictionary encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..skew import MAX_GROUP_ROWS, durable, global_position, ranked_in_group


def split_key(seed: int, *columns: str) -> Column:
    """Repeatable shuffle key: a row's place does not depend on partitions or arrival order."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def split_per_user(
    df: DataFrame,
    train_ratio: float = 0.8,
    key: str = "row_key",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``split``: the first ``floor(n * ratio)`` rows of each user by ``key`` train, the rest test.

    ``key`` holds a hexadecimal digest (see :func:`split_key`). Its first three digits spread the
    rows of an oversized user over 4096 equal parts.
    """
    ranked = ranked_in_group(
        df,
        "user_id",
        order=[F.col(key), F.col("item_id"), F.col("rating")],
        bucket=F.substring(key, 1, 3),
        rank_col="_rank",
        count_col="_n",
        limit=max_group_rows,
        digests=(key,) if df.schema[key].dataType == T.StringType() else (),
    )
    cut = F.floor(F.col("_n") * F.lit(float(train_ratio)))
    return ranked.withColumn(
        "split", F.when(F.col("_rank") <= cut, "train").otherwise("test")
    ).drop("_rank", "_n")


def train_part(split: DataFrame) -> DataFrame:
    return split.filter(F.col("split") == "train").drop("split")


def test_part(split: DataFrame) -> DataFrame:
    return split.filter(F.col("split") == "test").drop("split")


def eligible_users(
    train: DataFrame,
    test: DataFrame,
    min_train_ratings: int = 5,
    min_test_ratings: int = 1,
    max_users: int | None = None,
) -> DataFrame:
    """Users with enough train and test rows; only the first ``max_users`` in id order if asked."""
    n_train = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_train"))
    n_test = test.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_test"))
    joined = n_train.filter(F.col("n_train") >= min_train_ratings).join(
        n_test.filter(F.col("n_test") >= max(min_test_ratings, 1)), "user_id"
    )
    if min_test_ratings <= 0:
        joined = n_train.filter(F.col("n_train") >= min_train_ratings).join(
            n_test, "user_id", "left"
        ).fillna(0, ["n_test"])
    return joined.orderBy("user_id").limit(max_users) if max_users else joined


def small_dataset(train: DataFrame, test: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the eligible users."""
    keep = eligible_users(train, test, **kwargs).select("user_id")
    return train.join(keep, "user_id", "left_semi"), test.join(keep, "user_id", "left_semi")


def dataset_sizes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Users, train rows and test rows of a (subset) split, one row."""
    rows = train.select("user_id", F.lit(1).alias("t")).unionAll(
        test.select("user_id", F.lit(0).alias("t"))
    )
    per_user = rows.groupBy("user_id").agg(
        F.sum("t").alias("n_train"), F.count(F.lit(1)).alias("n")
    )
    return per_user.agg(
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.sum("n_train"), F.lit(0)).cast("long").alias("train_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("n_train")), F.lit(0)).cast("long").alias("test_rows"),
    )


def id_index(df: DataFrame, id_col: str, idx_col: str, durable_copy: bool = False) -> DataFrame:
    """Contiguous integers from 0 for the distinct ids, in id order."""
    ids = df.select(id_col).distinct()
    index = global_position(ids, [F.col(id_col)], idx_col, start=0)
    return durable(index) if durable_copy else index


def grow_index(index: DataFrame, df: DataFrame, id_col: str, idx_col: str) -> DataFrame:
    """``index`` with the new ids of ``df`` appended: known ids keep their numbers, new ones follow
    the largest number in id order. An empty index starts at 0; ids that are null get no number."""
    new = df.select(id_col).filter(F.col(id_col).isNotNull()).distinct().join(
        index.select(id_col), id_col, "left_anti")
    last = index.agg(F.max(idx_col)).first()[0]
    added = global_position(new, [F.col(id_col)], idx_col, start=0 if last is None else last + 1)
    return index.select(id_col, F.col(idx_col).cast("long").alias(idx_col)).unionByName(added)
