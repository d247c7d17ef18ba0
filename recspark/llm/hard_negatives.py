"""Hard negatives by angular triangle filtering.

Vectors become integers, ``floor(scale * x)``. Every row stores its angle to a few reference
directions. For two vectors, the angles to one reference differ by no more than the angle between
them, and add up to no less, so every reference narrows the angle between an anchor and a row; the
cosines of that interval times both norms, widened by more than any rounding, bound their score.

Rows lie in segments, ordered by their nearest reference and the angle to it, and a segment knows the
range of its angles and norms. Anchors travel in chunks with ranges of their own. Only chunks and
segments whose bounds can matter are brought together, and inside, only rows whose bounds can matter
are scored in integers: for positives those that may reach the best scores found in the anchor's own
segment, for negatives those whose bounds overlap a window of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

SCALE = 256
REFERENCES = 16
SEGMENT_ROWS = 4096
CHUNK = 128
# Angles are off by less than this: the arc cosine of a rounded cosine near 1 is the worst case.
ANGLE_SLACK = 1e-6
# Integers and their sums of products below this are exact in double precision.
EXACT = float(1 << 53)

LEAST, MOST = -(1 << 63), (1 << 63) - 1

ENTRY = "vec_id long, label long, floor long, v array<long>"
ROWS = ("segment long, n int, dims int, ids binary, labels binary, floors binary, vectors binary, "
        "angles binary, norms binary, low array<double>, high array<double>")


@dataclass
class Rows:
    """Vectors of a segment or chunk with ids, labels, angles and norms."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    angles: np.ndarray
    norms: np.ndarray

    @classmethod
    def read(cls, r: dict, width: int) -> "Rows":
        n = r["n"]
        v = np.frombuffer(r["vectors"], "<i8").reshape(n, r["dims"])
        return cls(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"),
                   np.pad(v, ((0, 0), (0, width - r["dims"]))),
                   np.frombuffer(r["angles"], "<f8").reshape(n, -1), np.frombuffer(r["norms"], "<f8"))

    def bounds(self, other: "Rows") -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the score of every own row with every other one."""
        near = np.zeros((len(self.ids), len(other.ids)))
        far = np.full_like(near, np.pi)
        for r in range(self.angles.shape[1]):
            a, b = self.angles[:, r, None], other.angles[None, :, r]
            np.maximum(near, np.abs(a - b), out=near)
            both = a + b
            np.minimum(far, np.minimum(both, 2 * np.pi - both), out=far)
        return _score_bounds(near, far, *[np.outer(self.norms, other.norms)] * 2)

    def scores(self, other: "Rows", own: int, rows: np.ndarray) -> np.ndarray:
        """Integer scores of one own row with some other ones."""
        q, v = self.v[own], other.v[rows]
        size = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(len(q), 1)
        if size < EXACT:
            return (v.astype(float) @ q.astype(float)).astype(np.int64)
        return np.clip(v.astype(object) @ q.astype(object), LEAST, MOST).astype(np.int64)


def _score_bounds(near, far, least, most) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a score from bounds of its angle and of the product of the norms."""
    high = np.cos(np.maximum(near - 2 * ANGLE_SLACK, 0.0))
    low = np.cos(np.minimum(far + 2 * ANGLE_SLACK, np.pi))
    slack = 1.0 + 1e-9 * most
    return (np.where(low >= 0, low * least, low * most) - slack,
            np.where(high >= 0, high * most, high * least) + slack)


def angles_to(v: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of vectors to the references, and their norms. A zero vector scores 0 with all others
    at any angle; it is given a right one."""
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    wide = max(v.shape[1], references.shape[1])
    x = np.pad(v.astype(float), ((0, 0), (0, wide - v.shape[1])))
    r = np.pad(references.astype(float), ((0, 0), (0, wide - references.shape[1])))
    size = np.sqrt((r ** 2).sum(axis=1))
    cos = (x @ r.T) / np.maximum(np.outer(norms, size), 1e-300)
    return np.arccos(np.clip(cos, -1.0, 1.0)), norms


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, with integer components."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (
        F.abs(c.cast("double")) != F.lit(float("inf"))))
    return rows.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & F.coalesce(fine, F.lit(False))
    ).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
             F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def reference_directions(vectors: DataFrame, count: int = REFERENCES) -> np.ndarray:
    """Vectors that serve as reference directions: the first by digest. At most ``count`` rows reach
    the driver; which they are affects the work, not the result."""
    found = [r["v"] for r in vectors.filter(F.exists("v", lambda c: c != 0)).orderBy(
        F.xxhash64("v"), "v").limit(count).select("v").collect()]
    wide = max((len(v) for v in found), default=1)
    return np.array([v + [0] * (wide - len(v)) for v in found] or [[1]], dtype=np.int64)


def located(vectors: DataFrame, references: np.ndarray) -> DataFrame:
    """``vec_id, label, floor, v`` with the nearest reference and the angle to it."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = batch.column("v").to_pylist()
            angles, _ = angles_to(_matrix(rows), references)
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)),
                 pa.array(angles[np.arange(len(rows)), near])],
                [*batch.schema.names, "near", "angle"])

    return vectors.select("vec_id", "label", "floor", "v").mapInArrow(
        run, f"{ENTRY}, near int, angle double")


def _matrix(rows: list[list[int]]) -> np.ndarray:
    m = np.zeros((len(rows), max((len(v) for v in rows), default=0)), dtype=np.int64)
    for i, v in enumerate(rows):
        m[i, :len(v)] = v
    return m


def _pack(references: np.ndarray):
    """Rows of ``segment, vec_id, label, floor, v`` in order of segments to one row per segment."""
    def row(segment: int, held: list[tuple]) -> pa.RecordBatch:
        v = _matrix([h[3] for h in held])
        angles, norms = angles_to(v, references)
        # Ranges of every angle, then of the norm.
        low = [*angles.min(axis=0).tolist(), float(norms.min())]
        high = [*angles.max(axis=0).tolist(), float(norms.max())]
        raw = [np.array([h[k] for h in held], dtype="<i8").tobytes() for k in range(3)]
        return pa.RecordBatch.from_arrays(
            [pa.array([segment], pa.int64()), pa.array([len(held)], pa.int32()),
             pa.array([v.shape[1]], pa.int32()),
             *[pa.array([b], pa.binary()) for b in (
                 *raw, v.astype("<i8").tobytes(), angles.astype("<f8").tobytes(),
                 norms.astype("<f8").tobytes())],
             pa.array([low], pa.list_(pa.float64())), pa.array([high], pa.list_(pa.float64()))],
            [c.split()[0] for c in ROWS.split(", ")])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in stream:
            for seg, *entry in zip(*[batch.column(c).to_pylist()
                                     for c in ("segment", "vec_id", "label", "floor", "v")],
                                   strict=True):
                if held and seg != at:
                    yield row(at, held)
                    held = []
                at = seg
                held.append(tuple(entry))
        if held:
            yield row(at, held)

    return run


def packed(rows: DataFrame, references: np.ndarray, size: int) -> DataFrame:
    """Stored segments of at most ``size`` rows that lie near each other."""
    parts = max(1, ceil(rows.count() / size))
    place = ["near", "angle", "vec_id"]
    ordered = rows.repartitionByRange(parts, *place, F.xxhash64("v")).sortWithinPartitions(*place)
    m = F.monotonically_increasing_id()
    segment = F.shiftright(m, 33) * F.lit(1 << 20) + F.floor(m.bitwiseAND((1 << 33) - 1) / size)
    return stored(ordered.select(segment.cast("long").alias("segment"), "vec_id", "label", "floor", "v")
                  .mapInArrow(_pack(references), ROWS), "segments")


def _span_bounds(a_low: Column, a_high: Column, b_low: Column, b_high: Column,
                 n: int) -> tuple[Column, Column]:
    """Bounds of all scores between two packed rows, from their ranges of angles and norms."""
    gaps = [F.lit(0.0)] + [F.greatest(b_low[k] - a_high[k], a_low[k] - b_high[k]) for k in range(n)]
    ends = [F.lit(np.pi)] + [e for k in range(n) for e in (
        a_high[k] + b_high[k], 2 * np.pi - a_low[k] - b_low[k])]
    high = F.cos(F.greatest(F.greatest(*gaps) - 2 * ANGLE_SLACK, F.lit(0.0)))
    low = F.cos(F.least(F.least(*ends) + 2 * ANGLE_SLACK, F.lit(np.pi)))
    least, most = a_low[n] * b_low[n], a_high[n] * b_high[n]
    slack = 1.0 + 1e-9 * most
    return (F.when(low >= 0, low * least).otherwise(low * most) - slack,
            F.when(high >= 0, high * most).otherwise(high * least) + slack)


def meetings(chunks: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """Pairs of a chunk of anchors and a segment whose scores may fall into ``want_low`` to
    ``want_high`` of the chunk. Only ranges are compared here, a few hundred bytes a side; vectors
    join the pairs that remain."""
    ranges = index.select(F.col("segment").alias("s"), F.col("low").alias("s_low"),
                          F.col("high").alias("s_high"))
    asked = chunks.select("segment", "low", "high", "want_low", "want_high")
    low, high = _span_bounds(F.col("low"), F.col("high"), F.col("s_low"), F.col("s_high"), n)
    return asked.join(ranges, (high >= F.col("want_low")) & (low <= F.col("want_high"))).select(
        F.col("segment").alias("chunk"), F.col("s").alias("segment"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _home(mod: int, k: int):
    """Anchors of a segment with the k-th best score among other rows of their label in it (``LEAST``
    if there are fewer): none of their best ``k`` scores less."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for r in batch.to_pylist():
                rows = Rows.read(r, r["dims"])
                out = []
                for i in np.flatnonzero(rows.ids % mod == 0):
                    mates = np.flatnonzero(
                        (rows.labels == rows.labels[i]) & (rows.ids != rows.ids[i]))
                    s = rows.scores(rows, i, mates)
                    floor = int(np.sort(s)[-k]) if len(s) >= k else LEAST
                    out.append((int(rows.ids[i]), int(rows.labels[i]), floor, rows.v[i].tolist()))
                yield _batch(out, {"vec_id": pa.int64(), "label": pa.int64(), "floor": pa.int64(),
                                   "v": pa.list_(pa.int64())})

    return run


def _batch(rows: list[tuple], types: dict) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _listed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of chunks: ``chunk, at, anchor_id, floor``."""
    for batch in stream:
        for r in batch.select(["segment", "n", "ids", "floors"]).to_pylist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["segment"]] * r["n"], pa.int64()), pa.array(range(r["n"]), pa.int32()),
                 pa.array(np.frombuffer(r["ids"], "<i8")),
                 pa.array(np.frombuffer(r["floors"], "<i8"))],
                ["chunk", "at", "anchor_id", "floor"])


def _wants(row: dict) -> list[list[tuple[int, int, int]]]:
    """Windows ``(tag, low, high)`` of every anchor of a chunk."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(row["q_n"])]
    for w in row["wants"]:
        out[w["at"]].append((w["tag"], w["low"], w["high"]))
    return out


FOUND = "chunk long, at int, tag int, vec_id long, score long"


# Chunks whose best scores a task remembers.
RECENT = 64


def _search(k: int, same_label: bool):
    """Best ``k`` rows of a segment for every window of every anchor of a chunk. Bounds pick the rows
    that are scored in integers; windows are then applied to the scores. What a task found for a chunk
    in earlier segments raises the lower ends of its windows to the ``k``-th best score so far."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, dict] = {}
        for batch in stream:
            for r in batch.to_pylist():
                if r["chunk"] not in recent and len(recent) >= RECENT:
                    del recent[next(iter(recent))]
                best = recent.setdefault(r["chunk"], {})
                width = max(r["q_dims"], r["dims"])
                q = Rows.read({c[2:]: x for c, x in r.items() if c.startswith("q_")}, width)
                rows = Rows.read(r, width)
                low, high = q.bounds(rows)
                out = []
                for i, wants in enumerate(_wants(r)):
                    fit = (rows.labels == q.labels[i]) == same_label
                    fit &= rows.ids != q.ids[i]
                    open_ = np.zeros(len(rows.ids), dtype=bool)
                    held = [(tag, max(a, _floor(best, i, tag, k)), b) for tag, a, b in wants]
                    for _, a, b in held:
                        open_ |= (high[i] >= a) & (low[i] <= b)
                    some = np.flatnonzero(fit & open_)
                    if not len(some):
                        continue
                    s = q.scores(rows, i, some)
                    for tag, a, b in held:
                        inside = np.flatnonzero((s >= a) & (s <= b))
                        top = inside[_best(s[inside], rows.ids[some[inside]], k)]
                        if len(top):
                            both = np.append(best.get((i, tag), np.zeros(0, s.dtype)), s[top])
                            best[i, tag] = np.sort(both)[-k:]
                        out += [(r["chunk"], i, tag, int(rows.ids[some[t]]), int(s[t]))
                                for t in top]
                yield _batch(out, {"chunk": pa.int64(), "at": pa.int32(), "tag": pa.int32(),
                                   "vec_id": pa.int64(), "score": pa.int64()})

    return run


def _floor(best: dict, i: int, tag: int, k: int) -> int:
    """The ``k``-th best score so far, ``LEAST`` before there are as many."""
    found = best.get((i, tag), ())
    return int(found[0]) if len(found) == k else LEAST


def _found(chunks: DataFrame, wants: DataFrame, index: DataFrame, n: int, k: int,
           same_label: bool) -> DataFrame:
    """``chunk, at, tag, vec_id, score, rank``: the best ``k`` per wanted window, over all
    segments. ``wants`` holds ``chunk, at, tag, low, high``."""
    by_chunk = wants.groupBy("chunk").agg(
        F.collect_list(F.struct("at", "tag", "low", "high")).alias("wants"),
        F.min("low").alias("want_low"), F.max("high").alias("want_high"))
    asked = chunks.join(by_chunk.withColumnRenamed("chunk", "segment"), "segment")
    met = meetings(asked, index, n)
    names = ("n", "dims", "ids", "labels", "vectors", "angles", "norms")
    sides = asked.select(F.col("segment").alias("chunk"), "wants",
                         *[F.col(c).alias(f"q_{c}") for c in names])
    found = met.join(sides, "chunk").join(index.select("segment", *names), "segment").mapInArrow(
        _search(k, same_label), FOUND)
    best = W.partitionBy("chunk", "at", "tag").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor_mod: int = 100, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose ``vec_id`` is divisible by ``anchor_mod``. Their positives are the best
    ``positives`` other rows of their label; for each, the best ``negatives`` rows of another label
    that score ``low`` to ``high`` percent of the positive's score follow. Scores are inner products
    of integer vectors, ties go to the smaller id; beyond 64 bits they stay at the end of the range.
    Rows without id, label or vector, or with a null or non-finite component, take no part; shorter
    vectors end in zeros. Rows that repeat an id are never each other's positive or negative; as rows
    of other anchors each counts. Anchors that repeat with equal label and vector are asked once, with
    different ones separately. Other columns are ignored; without rows there are no results.
    """
    vectors = stored(usable(rows, scale), "vectors")
    references = reference_directions(vectors)
    n = len(references)
    index = packed(located(vectors.withColumn("floor", F.lit(LEAST)), references), references,
                   SEGMENT_ROWS)
    anchors = index.mapInArrow(_home(anchor_mod, positives), ENTRY)
    # Of equal anchors one asks, from the best floor that any of them found.
    distinct = stored(anchors.groupBy("vec_id", "label", "v").agg(F.max("floor").alias("floor")),
                      "anchors")
    chunks = packed(located(distinct, references), references, CHUNK)
    asked = stored(chunks.mapInArrow(_listed, "chunk long, at int, anchor_id long, floor long"),
                   "asked")
    wanted = asked.select("chunk", "at", F.lit(0).alias("tag"), F.col("floor").alias("low"),
                          F.lit(MOST).alias("high"))
    good = stored(_found(chunks, wanted, index, n, positives, True).select(
        "chunk", "at", F.col("rank").alias("tag"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(19,0)")

    def percent(x: int, more: int) -> Column:
        whole = score * F.lit(x).cast("decimal(10,0)") + F.lit(more).cast("decimal(10,0)")
        return F.call_function("div", whole, F.lit(100).cast("decimal(10,0)"))

    # A score is at least x percent if it is at least that rounded up. No score lies between a
    # larger and a smaller share of a negative one.
    windows = good.filter(F.col("positive_score") >= 0).select(
        "chunk", "at", "tag", percent(low, 99).alias("low"), percent(high, 0).alias("high"))
    bad = _found(chunks, windows, index, n, negatives, False)
    return bad.join(good, ["chunk", "at", "tag"]).join(asked, ["chunk", "at"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
