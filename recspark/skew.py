"""Helpers that keep work spread out when one key owns a large share of the rows.

Plain group aggregates are safe already (Spark combines on the map side) and skewed joins are split
by adaptive execution. Windows are neither, so anything that numbers *all* rows of a group goes
through :func:`ranked_in_group`, and anything that numbers a whole table goes through
:func:`global_position`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Rows of one group that a single task may sort.
MAX_GROUP_ROWS = 1_000_000
# Rows of a whole table that a single task may sort.
MAX_SINGLE_TASK_ROWS = 1_000_000
# Rows of a stored table that a join may still collect in the driver and send to every executor.
MAX_BROADCAST_ROWS = 100_000
# Whether the shuffle files of a query are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's own, or a temporary one on a local master only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="recspark-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
            codec: str | None = None) -> DataFrame:
    """Write to the checkpoint folder and read back; ``codec`` names a Parquet compression.

    Cuts the lineage, so a lost executor costs one read and computes the rows once. (``checkpoint()``
    would compute the last stage twice.) Spark takes the size of the files for the size of the table,
    and lists that resemble each other shrink to a byte a row on disk: tables of more rows than
    ``max_broadcast_rows`` ask for merge joins, or the driver would collect them.

    The shuffle files of the write go with it: nothing reads them again, and otherwise they stay until
    the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/recspark-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
        return stored.hint("merge") if stored.count() > max_broadcast_rows else stored
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def discard(stored: DataFrame) -> None:
    """Delete a table below the checkpoint folder whose rows a later stored table holds or no one reads."""
    spark = stored.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    root = root.getFileSystem(conf).makeQualified(root).toUri().getPath()
    for file in stored.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        while path.getParent() is not None and path.getParent().toUri().getPath() != root:
            path = path.getParent()
        if path.getParent() is not None:
            path.getFileSystem(conf).delete(path, True)


def oversized_keys(df: DataFrame, key: str | list[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and their row counts: at most ``rows / limit`` of them."""
    keys = [key] if isinstance(key, str) else list(key)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("group_rows"))
        .filter(F.col("group_rows") > limit)
    )


def ranked_in_group(
    df: DataFrame,
    key: str,
    order: list[Column],
    bucket: Column,
    rank_col: str,
    count_col: str | None = None,
    limit: int = MAX_GROUP_ROWS,
    digests: tuple[str, ...] = (),
) -> DataFrame:
    """``row_number`` (and group size) per ``key`` without ever sorting an oversized group in one task.

    ``bucket`` must grow with ``order`` (same bucket or a later one for a later row). Groups above
    ``limit`` are numbered bucket by bucket and shifted by the rows of their earlier buckets; all
    other groups use one ordinary window, to which the columns ``digests`` travel packed (``order``
    then refers to columns by name).
    """
    big = oversized_keys(df, key, limit)
    if not big.take(1):
        w = W.partitionBy(key)
        if digests:
            df = unpacked(packed(df, *digests).repartition(F.col(key)), *digests).select(*df.columns)
        out = df.withColumn(rank_col, F.row_number().over(w.orderBy(*order)).cast("long"))
        return out.withColumn(count_col, F.count(F.lit(1)).over(w)) if count_col else out

    tagged = (
        df.join(big, key, "left")
        .withColumn("_bucket", F.when(F.col("group_rows").isNotNull(), bucket))
    )
    sizes = (
        tagged.filter(F.col("group_rows").isNotNull())
        .groupBy(key, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    offsets = sizes.select(
        key,
        "_bucket",
        (
            F.sum("_rows").over(W.partitionBy(key).orderBy("_bucket")) - F.col("_rows")
        ).alias("_offset"),
    )
    part = W.partitionBy(key, "_bucket")
    out = (
        tagged.withColumn("_local", F.row_number().over(part.orderBy(*order)))
        .withColumn("_size", F.coalesce("group_rows", F.count(F.lit(1)).over(part)))
        .join(offsets, [key, "_bucket"], "left")
        .withColumn(rank_col, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long"))
    )
    if count_col:
        out = out.withColumn(count_col, F.col("_size"))
    return out.drop("group_rows", "_bucket", "_local", "_size", "_offset")


def global_position(
    df: DataFrame,
    order: list[Column],
    name: str,
    start: int = 1,
    limit: int = MAX_SINGLE_TASK_ROWS,
) -> DataFrame:
    """Contiguous positions ``start, start+1, …`` over the whole table in the given total order.

    The table is stored. One of checked size up to ``limit`` is numbered by one window. A larger one is
    range partitioned, stored again (range boundaries are sampled, so they must not be drawn twice) and
    numbered per partition plus the rows of the partitions before it. Positions are long at any size.
    """
    spark = df.sparkSession
    df = durable(df)
    if df.count() <= limit:
        return df.withColumn(
            name, (F.row_number().over(W.orderBy(*order)) + F.lit(start - 1)).cast("long")
        )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    placed = durable(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select(
        "_part", (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_offset")
    )
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (F.col("_local") + F.col("_offset") + F.lit(start - 1)).cast("long"))
        .drop("_part", "_local", "_offset")
        .hint("merge")  # more than ``limit`` rows: not to be collected either
    )


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many tasks as the session's shuffles have, for sorts of rows that compress well.

    Adaptive execution merges shuffle partitions by their compressed size. Rows of lists that resemble
    each other take a few bytes each there, and a task would sort millions of them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The strings of ``columns`` in bytes, for shuffles: hexadecimal digests take half their length.

    Any other string keeps its own bytes; :func:`unpacked` returns the very strings.
    """
    out = df
    for c in columns:
        digits = F.unhex(c)
        is_hex = F.coalesce(F.lower(F.hex(digits)) == F.col(c), F.lit(False))
        out = out.withColumns({
            c: F.when(is_hex, digits).otherwise(F.col(c).cast("binary")), f"_hex_{c}": is_hex})
    return out


def unpacked(df: DataFrame, *columns: str) -> DataFrame:
    """Undo :func:`packed`."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_hex_{c}"), F.lower(F.hex(c))).otherwise(
            F.col(c).cast("string"))).drop(f"_hex_{c}")
    return out


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan yields fewer partitions than there are cores.

    Meant ahead of per-row work that costs more than moving the row, such as text cleaning. Large
    inputs have more partitions than cores and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
