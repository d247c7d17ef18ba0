"""Packing token pieces into sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths, at most one row per possible length, is planned over: patterns
of up to three length grades that fill a sequence are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares and rounded, and what they leave is packed best-fit into
the space that is left. The plan says for every length which ranks go where, so pieces are placed by
their rank among the pieces of their length, without moving them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from . import tokens
from .common import slices, stored
from .huffman import END_ID

CAPACITY = 4096
# Length grades of the patterns; the shortest pieces are left to fill the gaps that rounding up
# to grades makes.
GRADES = 128
FILLER_GRADES = 4


# Bytes of ids after which a task hands rows on.
OUTPUT_BYTES = 4 << 20


# -- plan --------------------------------------------------------------------------------------------


def patterns(grades: int) -> np.ndarray:
    """Multisets of one to three grades that add up to ``grades``, as columns of counts."""
    out = []
    for a in range(1, grades + 1):
        if a == grades:
            out.append((a,))
        for b in range(a, grades - a + 1):
            if a + b == grades:
                out.append((a, b))
            c = grades - a - b
            if c >= b:
                out.append((a, b, c))
    found = np.zeros((grades + 1, len(out)))
    for k, p in enumerate(out):
        for g in p:
            found[g, k] += 1
    return found[1:]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x >= 0`` with the least ``|a x - b|`` (active sets)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(3 * n):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= limit:
            break
        free[j] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (trial <= 0)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - trial[bad], 1e-300))
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0.0
            if not free.any():
                break
        x = np.where(free, trial, 0.0)
    return np.maximum(x, 0.0)


class Plan:
    """Entries ``(length, first rank, bins, first sequence, offset, copies)``: ranks from the first
    on fill the bins one after the other, then the same bins again at the next offset."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.entries: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.used: dict[int, int] = {}              # ranks given out, by length
        self.open: dict[int, list[list[int]]] = {}  # bins by free space: [first sequence, bins]

    def bins(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def put(self, length: int, first: int, n: int, offset: int, copies: int = 1) -> None:
        rank = self.used.get(length, 0)
        self.entries.append((length, rank, n, first, offset, copies))
        self.used[length] = rank + n * copies

    def leave(self, first: int, n: int, free: int) -> None:
        if n and free:
            self.open.setdefault(free, []).append([first, n])

    def fill(self, length: int, count: int) -> None:
        """Best fit for ``count`` pieces of a length; new bins when no open one has room."""
        while count:
            free = min((f for f in self.open if f >= length), default=None)
            if free is None:
                fits = min(self.capacity // length, count)
                n = count // fits
                first, have, room = self.bins(n), n, self.capacity
            else:
                first, have = self.open[free].pop()
                if not self.open[free]:
                    del self.open[free]
                n, room = min(have, count), free
                fits = max(1, min(room // length, count // n))
            self.put(length, first, n, self.capacity - room, fits)
            self.leave(first, n, room - fits * length)
            self.leave(first + n, have - n, room)
            count -= n * fits

    def table(self) -> dict[str, np.ndarray]:
        rows = np.asarray(sorted(self.entries), dtype=np.int64).reshape(-1, 6)
        return {"length": rows[:, 0], "rank": rows[:, 1], "bins": rows[:, 2],
                "sequence": rows[:, 3], "offset": rows[:, 4]}


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY,
                 grades: int = GRADES) -> Plan:
    """Place ``{length: count}`` (lengths from 1 to ``capacity``) into sequences."""
    plan = Plan(capacity)
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        left[n] = c
    if left[capacity]:
        plan.put(capacity, plan.bins(int(left[capacity])), int(left[capacity]), 0)
        left[capacity] = 0
    width = -(-capacity // grades)
    edges = np.minimum(np.arange(grades + 1) * width, capacity)
    total = np.concatenate(([0], np.cumsum(left[1:])))
    counts = np.diff(total[edges]).astype(np.float64)
    counts[:FILLER_GRADES] = 0
    shape = patterns(grades)
    shape = shape[:, (shape[counts == 0] == 0).all(axis=0)]
    if shape.shape[1]:
        # Rows are weighted by size: a long piece without a place costs more than a short one.
        weight = np.arange(1, grades + 1)[:, None] / grades
        repeat = np.rint(nnls(shape * weight, counts * weight[:, 0])).astype(np.int64)
        for k in np.argsort(-repeat, kind="stable"):
            slots = [g for g in range(grades, 0, -1) for _ in range(int(shape[g - 1, k]))]
            _realise(plan, slots, int(repeat[k]), left, edges)
    for n in np.flatnonzero(left)[::-1].tolist():
        plan.fill(n, int(left[n]))
    return plan


def _longest(left: np.ndarray, above: int, upto: int) -> int:
    """The longest length with pieces left in ``(above, upto]``, 0 if there is none."""
    found = np.flatnonzero(left[above + 1:upto + 1])
    return above + 1 + int(found[-1]) if len(found) else 0


def _realise(plan: Plan, slots: list[int], copies: int, left: np.ndarray,
             edges: np.ndarray) -> None:
    """Up to ``copies`` sequences of a pattern of grades, in runs of equal lengths.

    The last slot takes the longest piece that fits what its fellows really left, so that rounding
    up to grades wastes nothing; without one of its grade or more it stays open.
    """
    while copies > 0:
        sizes, space = [], plan.capacity
        for i, g in enumerate(slots):
            last = i == len(slots) - 1
            used = {n: sizes.count(n) for n in sizes}
            for n in used:
                left[n] -= used[n]
            size = _longest(left, int(edges[g - 1]), min(space, plan.capacity - 1)
                            if last else int(edges[g]))
            for n in used:
                left[n] += used[n]
            if not size:
                break
            sizes.append(size)
            space -= size
        if not sizes or (len(sizes) < len(slots) - 1):
            return
        n = min([copies] + [int(left[x]) // sizes.count(x) for x in set(sizes)])
        first, at = plan.bins(n), 0
        for size in sizes:
            plan.put(size, first, n, at)
            at += size
            left[size] -= n
        plan.leave(first, n, plan.capacity - at)
        copies -= n


# -- Spark -------------------------------------------------------------------------------------------


def _cut(vocabulary: str, capacity: int, schema: pa.Schema, width: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        end = np.asarray([END_ID], dtype="<u4").tobytes()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types, strict=True)],
                schema=schema)

        rows: list[tuple] = []
        size = 0
        for batch in slices(stream):
            for doc, ids in zip(batch.column("doc_id").to_pylist(),
                                enc.encode_all(batch.column("text").to_pylist()), strict=True):
                ids += end
                if width == 2:
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                for k, at in enumerate(range(0, len(ids), width * capacity)):
                    piece = ids[at:at + width * capacity]
                    rows.append((doc, k, at // width, len(piece) // width, piece))
                    size += len(piece)
                    if size > OUTPUT_BYTES:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    return run


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY,
           width: int = 4) -> DataFrame:
    """Token pieces of every text with the end id: ``doc_id, piece, start, length, ids``.

    Texts of more than ``capacity`` ids are cut into whole pieces and a last one; null texts are
    empty and give one piece with the end id. ``ids`` are little-endian unsigned numbers of ``width``
    bytes: 4, or 2 where the vocabulary allows it (see :func:`narrow`).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids", pa.binary())])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return texts.mapInArrow(_cut(vocabulary, capacity, schema, width),
                            "doc_id long, piece int, start long, length long, ids binary")


def narrow(vocabulary: str) -> int:
    """Bytes that hold every id of a vocabulary: 2 or 4."""
    size = tokens.encoder(vocabulary).tokenizer.get_vocab_size(with_added_tokens=True)
    return 2 if max(size, END_ID + 1) <= 1 << 16 else 4


def _ranked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the task's number and each row's rank among the task's rows of its length."""
    part, seen = TaskContext.get().partitionId(), np.zeros(0, dtype=np.int64)
    for batch in stream:
        size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
        top = int(size.max(initial=0)) + 1
        if top > len(seen):
            seen = np.pad(seen, (0, top - len(seen)))
        order = np.argsort(size, kind="stable")
        s = size[order]
        begin = np.searchsorted(s, s, side="left")
        rank = np.empty(len(s), dtype=np.int64)
        rank[order] = np.arange(len(s)) - begin + seen[s]
        seen += np.bincount(size, minlength=len(seen))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(s), part, np.int32)), pa.array(rank)],
            [*batch.schema.names, "_part", "_rank"])


def _placed(plan: dict[str, np.ndarray]):
    key = (plan["length"] << 44) | plan["rank"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            e = np.searchsorted(key, (size << 44) | rank, side="right") - 1
            local = rank - plan["rank"][e]
            bins = plan["bins"][e]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep],
                 pa.array(plan["sequence"][e] + local % bins),
                 pa.array(plan["offset"][e] + local // bins * size)],
                [*[batch.schema.names[i] for i in keep], "sequence_id", "offset"])

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; column ``length`` is from 1 to ``capacity``.

    All columns ride along (an input column named like one of the two is replaced). No rows give no
    rows. What reaches the driver is the histogram of lengths, at most ``capacity`` rows.
    """
    rows = rows.drop("sequence_id", "offset", "_part", "_rank")
    ranked = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()),
                           T.StructField("_rank", T.LongType())])
    held = stored(rows.mapInArrow(_ranked, ranked), "pieces", "zstd")
    per_part = held.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity).table()
    before = per_part.select("length", "_part", (
        F.sum("n").over(W.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))
    whole = held.join(before, ["length", "_part"]).withColumn(
        "_rank", F.col("_rank") + F.col("_before")).select(*rows.columns, "_rank")
    out = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()),
                        T.StructField("offset", T.LongType())])
    return whole.mapInArrow(_placed(plan), out)


_LISTS = {"doc_ids": pa.int64(), "pieces": pa.int32(), "starts": pa.int64(), "lengths": pa.int64(),
          "offsets": pa.int64()}
_SEQUENCES = pa.schema([("sequence_id", pa.int64()), ("length", pa.int64()),
                        *[(c, pa.list_(t)) for c, t in _LISTS.items()], ("ids", pa.binary())])
SEQUENCES = ("sequence_id long, length long, doc_ids array<long>, pieces array<int>, "
             "starts array<long>, lengths array<long>, offsets array<long>, ids binary")


def _assembled(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (sequence_id, offset) to one row per sequence, ids end to end."""
    done: list[tuple] = []
    held: list[tuple] = []
    size = 0

    def close() -> None:
        columns = list(zip(*[h[1:] for h in held], strict=True))
        done.append((held[0][0], sum(columns[3]), *map(list, columns[:5]), b"".join(columns[5])))

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*done), _SEQUENCES.types, strict=True)],
            schema=_SEQUENCES)

    for batch in slices(stream):
        for row in zip(*[batch.column(c).to_pylist() for c in (
                "sequence_id", "doc_id", "piece", "start", "length", "offset", "ids")], strict=True):
            if held and row[0] != held[0][0]:
                close()
                size += len(done[-1][-1])
                held = []
                if size > OUTPUT_BYTES:
                    yield made()
                    done, size = [], 0
            held.append(row)
    if held:
        close()
    if done:
        yield made()


def packed_sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences: ``sequence_id, length, doc_ids, pieces, starts, lengths, offsets, ids`` with
    the pieces in their places and the ids end to end. A sequence holds at most ``capacity`` pieces."""
    return _by_sequence(placed).mapInArrow(_assembled, SEQUENCES)


def _by_sequence(placed: DataFrame) -> DataFrame:
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset")


CONTENTS = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
            "offset long")


def _taken_apart(width: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, 50):
            for r in batch.to_pylist():
                raw = memoryview(np.frombuffer(r["ids"], f"<u{width}").astype("<u4")).cast("B")
                n = len(r["doc_ids"])
                digests = [zlib.crc32(raw[4 * at:4 * (at + size)])
                           for at, size in zip(r["offsets"], r["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["pieces"], pa.int32()),
                     pa.array(r["starts"], pa.int64()), pa.array(r["lengths"], pa.int64()),
                     pa.array(digests, pa.int64()), pa.array([r["sequence_id"]] * n, pa.int64()),
                     pa.array(r["offsets"], pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def sequence_contents(sequences: DataFrame, width: int = 4) -> DataFrame:
    """What whole sequences hold, read back from their ids: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset`` of every piece. The digest is that of the ids at the piece's
    place, as 32-bit numbers whatever the ``width`` they are kept in."""
    return sequences.mapInArrow(_taken_apart(width), CONTENTS)


def packed_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json",
                  capacity: int = CAPACITY) -> DataFrame:
    """Encode, pack and lay out every text; the contents of the sequences. Ids are kept as narrow as
    the vocabulary allows, since they move twice. A task lays out a sequence and reads it back before
    it goes on to the next."""
    width = narrow(vocabulary)
    placed = pack(pieces(docs, vocabulary, capacity, width), capacity)
    read = _taken_apart(width)
    return _by_sequence(placed).mapInArrow(lambda stream: read(_assembled(stream)), CONTENTS)
