"""K-d tree sharding by bytes, with built-in functions only.

Coordinates are the places of source and language among their distinct values, the size and the id.
A node of the tree holds a run of shards. It is cut along the metadata dimension in which its rows
are widest, at the weighted median (in proportion to the shards on either side), until a leaf is one
shard. Medians come from sums of bytes by (node, bucket): the bucket in which the wanted weight is
reached is looked at again in finer buckets. Copies of a text share their metadata and their hash,
so they lie side by side in every dimension, and only a cut that falls inside a group parts them.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..skew import global_position
from .common import stored

# Bits of a row's place along the cut dimension that one pass over the rows resolves, and in all:
# 16 of the coordinate, 32 of the text's hash, 15 of the row's.
STEP_BITS = 16
PLACE_BITS = 63
# A cut is fine enough when the bucket it falls into weighs less than this share of a shard.
TOLERANCE = 0.002
# Rows that one window numbers, about.
SLOT_ROWS = 20_000


def _ranks(groups: DataFrame, name: str) -> DataFrame:
    """Places of the distinct values of a column in their order, from 1."""
    values = groups.select(name).filter(F.col(name).isNotNull()).distinct()
    return global_position(values, [F.col(name)], f"d_{name}").select(
        name, F.col(f"d_{name}").cast("double").alias(f"d_{name}"))


def _metadata(docs: DataFrame) -> DataFrame:
    """Narrow rows: id, size, checksum, hashes and the coordinates of the row's text group."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.col("source").alias("source"), F.col("lang").alias("lang"),
    )
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("text_hash", "size").agg(
        F.min("source").alias("source"), F.min("lang").alias("lang"),
        F.min("doc_id").cast("double").alias("d_id"),
    ).withColumn("d_size", F.log2(F.col("size").cast("double")))
    for name in ("source", "lang"):
        groups = groups.join(_ranks(rows, name), name, "left").drop(name)
    return stored(
        rows.drop("source", "lang").join(groups, ["text_hash", "size"])
        .withColumn("row_hash", F.xxhash64("doc_id", "text_hash", F.lit("row"))),
        "shard-metadata")


DIMENSIONS = ("d_source", "d_lang", "d_size", "d_id")


def _cases(node: Column, values: dict[int, object], kind: str) -> Column:
    """A value by node, as a map over at most as many nodes as there are shards."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))]
    return F.element_at(F.create_map(*pairs), node)


def split_tree(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with a ``shard`` column; columns ``DIMENSIONS``, ``size`` and both hashes are read.

    The driver sees one row per node and pass: at most ``shards`` of them.
    """
    spans = rows.agg(
        F.sum("size").alias("all"),
        *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    if spans["all"] is None:
        return rows.withColumn("shard", F.lit(0))
    wide = {d: (spans[f"hi_{d}"] or 0.0) - (spans[f"lo_{d}"] or 0.0) for d in DIMENSIONS}
    enough = TOLERANCE * spans["all"] / shards
    shard = F.lit(0)
    nodes = {0: shards}  # first shard: number of shards
    while any(n > 1 for n in nodes.values()):
        cut = {k: n for k, n in nodes.items() if n > 1}
        tagged = rows.withColumn("node", shard).filter(F.col("node").isin(list(cut)))
        stats = tagged.groupBy("node").agg(
            F.sum("size").alias("weight"),
            *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))])
        axis, low, scale, need = {}, {}, {}, {}
        for s in stats.collect():
            k = s["node"]
            width = {d: ((s[f"hi_{d}"] or 0.0) - (s[f"lo_{d}"] or 0.0)) / wide[d] if wide[d] else 0.0
                     for d in DIMENSIONS}
            d = max(DIMENSIONS, key=lambda x: width[x])
            axis[k], low[k] = d, s[f"lo_{d}"] or 0.0
            gap = (s[f"hi_{d}"] or 0.0) - low[k]
            scale[k] = ((1 << STEP_BITS) - 1) / gap if gap > 0 else 0.0
            need[k] = s["weight"] * (cut[k] // 2) / cut[k]
        cut = {k: n for k, n in cut.items() if k in axis}
        if not cut:
            break
        value = F.coalesce(
            *[F.when(_cases(F.col("node"), axis, "string") == d, F.col(d)) for d in DIMENSIONS],
            _cases(F.col("node"), low, "double"))
        coordinate = F.floor(
            (value - _cases(F.col("node"), low, "double")) * _cases(F.col("node"), scale, "double")
        ).cast("long")
        place = (
            F.shiftleft(coordinate, PLACE_BITS - STEP_BITS)
            .bitwiseOR(F.shiftleft(F.col("text_hash").bitwiseAND(0xFFFFFFFF), 15))
            .bitwiseOR(F.col("row_hash").bitwiseAND(0x7FFF))
        )
        placed = tagged.select("node", "size", place.alias("place"))
        below = dict.fromkeys(cut, 0)   # rows with a smaller place go left
        prefix: dict[int, int] = dict.fromkeys(cut, 0)
        open_, depth = dict(need), 0
        while open_ and depth < PLACE_BITS:
            before, depth = depth, min(depth + STEP_BITS, PLACE_BITS)
            live = {k: prefix[k] for k in open_}
            inside = placed.filter(F.col("node").isin(list(live))).filter(
                F.shiftright("place", PLACE_BITS - before) == _cases(F.col("node"), live, "long")
            ) if before else placed
            sums = inside.groupBy(
                "node", F.shiftright("place", PLACE_BITS - depth).alias("bucket")
            ).agg(F.sum("size").alias("size")).withColumn(
                "upto", F.sum("size").over(W.partitionBy("node").orderBy("bucket")))
            want = _cases(F.col("node"), open_, "double")
            edge = sums.filter(F.col("upto") >= want).groupBy("node").agg(
                F.min_by(F.struct("bucket", "size", "upto"), "bucket").alias("b"))
            hit = {r["node"]: r["b"] for r in edge.collect()}
            for k in list(open_):
                b = hit[k]
                rest = open_[k] - (b["upto"] - b["size"])
                if b["size"] <= enough or depth >= PLACE_BITS:
                    step = 1 if 2 * rest >= b["size"] else 0
                    below[k] = (b["bucket"] + step) << (PLACE_BITS - depth)
                    del open_[k]
                else:
                    prefix[k], open_[k] = b["bucket"], rest
        # A cut above the last place needs 64 bits; nothing lies beyond it then.
        below = {k: min(v, (1 << 63) - 1) for k, v in below.items()}
        moved = {k: k + n // 2 for k, n in cut.items()}
        right = place >= _cases(F.col("node"), below, "long")
        rows = stored(
            rows.withColumn("node", shard).withColumn(
                "shard", F.when(F.col("node").isin(list(cut)) & right,
                                _cases(F.col("node"), moved, "int")).otherwise(F.col("node")))
            .drop("node"), "shard-level")
        nodes = {k: n for old, m in nodes.items() for k, n in (
            ((old, m // 2), (old + m // 2, m - m // 2)) if old in cut else ((old, 1),))}
        shard = F.col("shard")
    return rows.withColumn("shard", shard.cast("int"))


def numbered(rows: DataFrame) -> DataFrame:
    """``slot``: gapless places from 0 within every shard, without a window over a whole shard.

    Rows are numbered within (shard, bucket of the row's hash) and shifted by the earlier buckets.
    """
    n = rows.count()
    buckets = max(1, ceil(n / SLOT_ROWS))
    rows = rows.withColumn("_bucket", F.pmod("row_hash", F.lit(buckets)))
    sizes = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("_n"))
    local = F.row_number().over(
        W.partitionBy("shard", "_bucket").orderBy("row_hash", "doc_id")) - 1
    return (
        rows.withColumn("_local", local)
        .join(sizes.drop("_n"), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_bucket", "_local", "_before")
    )


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: one row per row of ``docs``.

    Size is the text's UTF-8 bytes plus 16. Null texts count as empty; nulls in other columns take
    the lowest coordinate. Rows that repeat id and text keep their own slots. Equal texts stay in
    one shard unless a cut falls inside their group. No rows give no rows; other columns are
    ignored.
    """
    return numbered(split_tree(_metadata(docs), shards)).select(
        "doc_id", "size", "text_crc32", "shard", "slot")
