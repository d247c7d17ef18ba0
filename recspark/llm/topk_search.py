"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integers, ``floor(scale * x)``, and are stored as a forward index: segments of blocks
of neighbouring ids, each block with its largest and smallest value of every term. A task gets one
segment and one chunk of queries. Per query it bounds every block by the sum of its terms' maxima,
scores the blocks in order of their bounds through the forward index, and stops at the first bound
below the k-th score so far. The best of all segments are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

# Vectors of a block, blocks of a segment, and queries of a chunk.
BLOCK = 128
SEGMENT_BLOCKS = 32
CHUNK = 256
# Sums of products below this are exact in double precision.
EXACT = float(1 << 53)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """``vec_id, v``: integer vectors of the rows that have one. Vectors that are null or hold null
    or non-finite components are left out, as are rows without an id."""
    x = F.col(f"`{vector_col}`")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (
        F.abs(c.cast("double")) != F.lit(float("inf"))))
    return rows.filter(x.isNotNull() & F.coalesce(fine, F.lit(False))
                       & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


SEGMENT = "segment long, ids binary, n int, dims int, vectors binary"


def _pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (segment, vec_id) to one row per segment; missing components are 0."""
    held: list[tuple[int, list]] = []
    at = None

    def row() -> pa.RecordBatch:
        dims = max((len(v) for _, v in held), default=0)
        m = np.zeros((len(held), dims), dtype="<i8")
        for i, (_, v) in enumerate(held):
            m[i, :len(v)] = v
        ids = np.asarray([k for k, _ in held], dtype="<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
             pa.array([len(held)], pa.int32()), pa.array([dims], pa.int32()),
             pa.array([m.tobytes()], pa.binary())],
            ["segment", "ids", "n", "dims", "vectors"])

    for batch in stream:
        for seg, k, v in zip(batch.column("segment").to_pylist(),
                             batch.column("vec_id").to_pylist(),
                             batch.column("v").to_pylist(), strict=True):
            if held and seg != at:
                yield row()
                held = []
            at = seg
            held.append((k, v))
    if held:
        yield row()


def segments(vectors: DataFrame, per_segment: int) -> DataFrame:
    """Stored forward index of ``vec_id, v``: vectors of neighbouring ids side by side.

    Places in the order of ids come from a range partitioning: whole partitions are cut into
    segments, so no task sees more than its share.
    """
    n = max(1, ceil(vectors.count() / per_segment))
    ordered = vectors.repartitionByRange(n, "vec_id", F.xxhash64("v")).sortWithinPartitions("vec_id")
    placed = ordered.select(
        # The id counts rows within a partition in its low bits and partitions above.
        F.monotonically_increasing_id().alias("m"), "vec_id", "v")
    parts = F.shiftright("m", 33) * F.lit(1 << 20) + F.floor(
        F.col("m").bitwiseAND((1 << 33) - 1) / per_segment)
    return stored(placed.select(parts.cast("long").alias("segment"), "vec_id", "v").mapInArrow(
        _pack, SEGMENT), "segments")


def _matrix(raw: bytes, n: int, dims: int, width: int) -> np.ndarray:
    m = np.frombuffer(raw, dtype="<i8").reshape(n, dims)
    return np.pad(m, ((0, 0), (0, width - dims))) if dims < width else m


def search_segment(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray,
                   k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every query the ``k`` best ``(ids, scores)`` of a segment, its own row left out."""
    n, blocks = len(ids), range(0, len(ids), BLOCK)
    top = np.stack([v[b:b + BLOCK].max(axis=0) for b in blocks])
    low = np.stack([v[b:b + BLOCK].min(axis=0) for b in blocks])
    size = np.abs(q).max(initial=0) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float64 if size < EXACT else object
    q, v, top, low = (x.astype(kind) for x in (q, v, top, low))
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best_ids = [np.zeros(0, dtype=np.int64)] * len(q)
    best = [np.zeros(0, dtype=kind)] * len(q)
    live = np.arange(len(q))
    for step in range(len(top)):
        # A bound equal to the k-th score may still hide a smaller id.
        live = live[[len(best[i]) < k or bounds[i, order[i, step]] >= best[i][-1] for i in live]]
        if not len(live):
            break
        at = order[live, step]
        for b in np.unique(at):
            who = live[at == b]
            rows = slice(int(b) * BLOCK, min((int(b) + 1) * BLOCK, n))
            scores = q[who] @ v[rows].T
            for i, s in zip(who, scores, strict=True):
                other = ids[rows] != q_ids[i]
                good = other if len(best[i]) < k else other & (s >= best[i][-1])
                if good.any():
                    all_s = np.concatenate((best[i], s[good]))
                    all_i = np.concatenate((best_ids[i], ids[rows][good]))
                    first = np.lexsort((all_i, -all_s))[:k]
                    best[i], best_ids[i] = all_s[first], all_i[first]
    return list(zip(best_ids, best, strict=True))


def _search(k: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for r in batch.to_pylist():
                width = max(r["q_dims"], r["dims"])
                q = _matrix(r["q_vectors"], r["q_n"], r["q_dims"], width)
                v = _matrix(r["vectors"], r["n"], r["dims"], width)
                q_ids = np.frombuffer(r["q_ids"], "<i8")
                found = search_segment(q, q_ids, v, np.frombuffer(r["ids"], "<i8"), k)
                count = [len(i) for i, _ in found]
                scores = [np.asarray(s).astype(np.int64) for _, s in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(q_ids, count)),
                    pa.array(np.concatenate([i for i, _ in found])),
                    pa.array(np.concatenate(scores)),
                ], ["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of every query row.

    Ties go to the smaller id; queries with fewer candidates get all. Rows without a usable vector
    or id take no part. Shorter vectors count as ending in zeros. Rows that repeat an id are the
    same vector to themselves: none is a candidate of its own id, and as candidates of others each
    repeats. Repeated queries are asked once per distinct vector and share the ``k`` places. Other
    columns are ignored.
    """
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    index = segments(vectors, BLOCK * SEGMENT_BLOCKS)
    asked = segments(vectors.filter(is_query).distinct(), CHUNK)
    names = index.select("segment")
    chunks = asked.select(
        F.col("segment").alias("chunk"), F.col("ids").alias("q_ids"), F.col("n").alias("q_n"),
        F.col("dims").alias("q_dims"), F.col("vectors").alias("q_vectors"))
    # Every chunk meets every segment: that is the question. Chunks carry the list of segments.
    listed = names.agg(F.collect_list("segment").alias("all"))
    met = chunks.join(listed, F.lit(True)).select("*", F.explode("all").alias("segment")).drop("all")
    found = met.join(index, "segment").mapInArrow(
        _search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(
        W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
