"""Shared folders, stored intermediates and the word definition of all text operators here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word, as every operator here counts it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows that a task turns into Python objects at once.
SLICE_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where a local test sets none."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """Write a table below the shared folder and read it back; ``codec`` names a Parquet compression, and
    wide rows then go out in small row groups, which bounds what a task's writer holds.

    Lineage ends there, so a lost executor costs a read and not the work before it, and every later
    reader sees the same rows in the same files.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write
    if codec:
        writer = writer.option("compression", codec).option("parquet.block.size", 16 << 20)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def slices(stream: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches of a task in slices of few rows, so that little is turned into Python objects at
    once."""
    for batch in stream:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text leaves remainder 0 by 5; a missing id is never used for learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
