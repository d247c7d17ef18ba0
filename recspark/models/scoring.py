"""Top-N by inner product over a whole catalogue, with blocks left out that cannot reach a list.

Items are ordered by the length of their vectors and cut into blocks; users lie in blocks of their
own. A user block meets the item blocks one after the other, the longest items first, and its lists so
far give each user a floor: the score of the last place. A score is at most the product of both lengths,
so an item block is multiplied only with the users whose floor that product can reach. Products are made
in single precision with a bound of their error; those that may reach a list are made again.

Floors and lists use scores in one defined order of summation, rounded to ``SCORE_DIGITS``; the blocks
they are found in do not affect them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.blocks import lengths, matrix, products, rough_products, runs, where
from ..operators.topk import SCORE_DIGITS
from ..skew import durable, global_position

USER_BLOCK = 2048
ITEM_BLOCK = 8192
# Bytes of item vectors that are sent to every task at once.
BROADCAST_BYTES = 64 << 20
# Scores within this of a floor are looked at: more than rounding can make.
SLACK = 1e-7


def _block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _length(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


USER, SEEN, CANDIDATE = 0, 1, 2


def _user_blocks(users: DataFrame, places: DataFrame, n_blocks: int, tasks: int, seen: DataFrame,
                 candidates: DataFrame | None) -> DataFrame:
    """One row per block: ids and vectors of its users, and their seen items (and candidates) as places
    of the user in the block and of the item in the catalogue, by the latter. Pairs without a factor
    drop out."""
    rows = users.select("user_id", F.lit(USER).alias("kind"), "features", F.lit(None).cast("long").alias("pos"))
    for kind, pairs in ((SEEN, seen), (CANDIDATE, candidates)):
        if pairs is not None:
            # Empty, not null: Arrow goes back over a run of nulls at every row.
            rows = rows.unionByName(pairs.join(places, "item_id").select(
                "user_id", F.lit(kind).alias("kind"),
                F.array().cast("array<float>").alias("features"), "pos"))
    # One number to sort by, which compares no rows.
    rows = rows.withColumn("ub", _block("user_id", n_blocks)).repartition(tasks, "ub").withColumn(
        "key", F.col("ub") * 4 + F.col("kind")).sortWithinPartitions("key")

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ub, rows in runs(stream, "ub"):
            kinds = rows.column("kind").to_numpy()
            starts = np.searchsorted(kinds, [USER, SEEN, CANDIDATE, CANDIDATE + 1])
            if starts[USER] == starts[SEEN]:
                continue
            own = rows.slice(0, starts[SEEN])
            ids = own.column("user_id").combine_chunks()
            index = pd.Index(ids.to_pandas())
            out = [[ub], [ids], [matrix(own.column("features")).astype("<f4").tobytes()]]
            for kind in (SEEN, CANDIDATE):
                part = rows.slice(starts[kind], starts[kind + 1] - starts[kind])
                at = index.get_indexer(part.column("user_id").to_pandas()).astype("<i4")
                pos = part.column("pos").to_numpy().astype("<i8")
                at, pos = at[at >= 0], pos[at >= 0]
                order = np.argsort(pos, kind="stable")
                out += [[at[order].tobytes()], [pos[order].tobytes()]]
            types = [pa.int32(), pa.list_(ids.type), *[pa.binary()] * 5]
            out[1] = pa.ListArray.from_arrays(np.array([0, len(ids)], np.int32), ids)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)],
                ["ub", "ids", "vec", "seen_at", "seen_pos", "cand_at", "cand_pos"])

    id_type = users.schema["user_id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"ub int, ids array<{id_type}>, vec binary, seen_at binary, "
                                 "seen_pos binary, cand_at binary, cand_pos binary")


def _item_blocks(items: DataFrame, tasks: int) -> DataFrame:
    """One row per block of the catalogue, in its order."""
    rows = items.select("ib", "pos", "item_id", "features", "size").repartition(
        tasks, "ib").sortWithinPartitions("ib", "pos")

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ib, rows in runs(stream, "ib"):
            ids = rows.column("item_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([
                pa.array([ib], pa.int32()), pa.array([rows.column("pos")[0].as_py()], pa.int64()),
                pa.ListArray.from_arrays(np.array([0, len(ids)], np.int32), ids),
                pa.array([matrix(rows.column("features")).astype("<f4").tobytes()], pa.binary()),
                pa.array([rows.column("size")[0].as_py()], pa.float64())],
                ["ib", "ib_pos", "ib_ids", "ib_vec", "ib_top"])

    id_type = items.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"ib int, ib_pos long, ib_ids array<{id_type}>, ib_vec binary, ib_top double")


def _first(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int):
    """The first ``n`` places by row, score and id."""
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return order[place < n]


def best_of_block(u: np.ndarray, v: np.ndarray, allowed: np.ndarray | None, item_ids: np.ndarray, n: int,
                  floors: np.ndarray, barred: tuple[np.ndarray, np.ndarray] | None = None,
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows, columns, scores`` of the best ``n`` allowed items per user that reach the user's floor,
    by user, score and item id. ``barred`` names pairs that are not allowed."""
    found = [], []
    for part, rough, error in rough_products(u, v):
        if allowed is not None:
            rough[~allowed[part]] = -np.inf
        if barred is not None:
            here = (barred[0] >= part.start) & (barred[0] < part.stop)
            rough[barred[0][here] - part.start, barred[1][here]] = -np.inf
        error = error + SLACK
        # What is not allowed stays below any bar.
        bar = np.maximum(floors[part] - error, np.finfo(rough.dtype).min)
        rows, cols = where(rough >= bar[:, None])
        count = np.bincount(rows, minlength=len(rough))
        many = np.flatnonzero(count > n)
        if len(many):
            last = -np.partition(-rough[many], n - 1, axis=1)[:, n - 1]
            bar[many] = np.maximum(bar[many], last - 2 * error[many])
            more, extra = where(rough[many] >= bar[many][:, None])
            few = count[rows] <= n
            rows, cols = (np.concatenate(x) for x in ((rows[few], many[more]), (cols[few], extra)))
        found[0].append(rows + part.start)
        found[1].append(cols)
    rows, cols = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in found)
    return _placed(u, v, rows, cols, item_ids, n, floors)


def _placed(u, v, rows, cols, item_ids, n, floors):
    # The sum of a pair has one order here, whatever the shapes of the blocks.
    scores = np.round(products(u, v, rows, cols), SCORE_DIGITS)
    keep = np.isfinite(scores) & (scores >= floors[rows])
    rows, cols, scores = rows[keep], cols[keep], scores[keep]
    first = _first(rows, item_ids[cols], scores, n)
    return rows[first], cols[first], scores[first]


class _Lists:
    """Lists of a user block while item blocks pass."""

    def __init__(self, row: dict, n: int, restricted: bool):
        self.ids, self.n, self.met = row["ids"].values, n, 0
        self.u = np.frombuffer(row["vec"].as_buffer(), "<f4").reshape(len(self.ids), -1)
        self.sizes = lengths(self.u)
        pairs = {}
        for name in ("seen", "cand"):
            pairs[name] = (np.frombuffer(row[f"{name}_at"].as_buffer(), "<i4"),
                           np.frombuffer(row[f"{name}_pos"].as_buffer(), "<i8"))
        self.seen, self.candidates = pairs["seen"], pairs["cand"] if restricted else None
        self.rows, self.items, self.scores = np.empty(0, np.int64), None, np.empty(0)
        if row["at"].is_valid:
            self.rows = np.frombuffer(row["at"].as_buffer(), "<i4").astype(np.int64)
            self.items = row["item_id"].values.to_numpy(zero_copy_only=False)
            self.scores = row["score"].values.to_numpy(zero_copy_only=False)
        self.floors = self._floors()

    def _floors(self) -> np.ndarray:
        floors = np.full(len(self.ids), -np.inf)
        count = np.bincount(self.rows, minlength=len(self.ids))
        full = count >= self.n
        floors[full] = self.scores[np.cumsum(count)[full] - 1]
        return floors

    def meet(self, row: dict) -> None:
        ids = row["ib_ids"].values.to_numpy(zero_copy_only=False)
        reach = np.flatnonzero(self.sizes * row["ib_top"].as_py() * (1 + SLACK) + SLACK >= self.floors)
        if self.items is None:
            self.items = ids[:0]
        if not len(reach):
            return
        v = np.frombuffer(row["ib_vec"].as_buffer(), "<f4").reshape(len(ids), -1)
        start = row["ib_pos"].as_py()

        def inside(pairs):
            here = slice(*np.searchsorted(pairs[1], [start, start + len(ids)]))
            return pairs[0][here].astype(np.int64), pairs[1][here] - start

        if self.candidates is not None:
            r, c = inside(self.candidates)
            code = r * len(ids) + c
            taken = inside(self.seen)
            fresh = np.unique(code[~np.isin(code, taken[0] * len(ids) + taken[1])])
            if not len(fresh):
                return
            r, c, s = _placed(self.u, v, fresh // len(ids), fresh % len(ids), ids, self.n, self.floors)
        else:
            local = np.full(len(self.ids), -1)
            local[reach] = np.arange(len(reach))
            r, c = inside(self.seen)
            known = local[r] >= 0
            r, c, s = best_of_block(self.u[reach], v, None, ids, self.n, self.floors[reach],
                                    (local[r[known]], c[known]))
            r = reach[r]
        self.met += 1
        if len(r):
            rows, items, scores = (np.concatenate(x) for x in (
                (self.rows, r), (self.items, ids[c]), (self.scores, s)))
            keep = _first(rows, items, scores, self.n)
            self.rows, self.items, self.scores = rows[keep], items[keep], scores[keep]
            self.floors = self._floors()

    def needed(self) -> float:
        """Length of the shortest item vector that could still reach a list."""
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(self.floors - SLACK <= 0, 0.0, np.where(
                self.sizes > 0, (self.floors - SLACK) / self.sizes, np.inf))
        return float(shortest.min(initial=np.inf))


def _kernel(n: int, restricted: bool, item_type: pa.DataType):
    """Lists of user blocks after all item blocks that came for them."""
    def state(ub: int, x: _Lists) -> pa.RecordBatch:
        items = pa.array([] if x.items is None else x.items, item_type)

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), values)

        return pa.RecordBatch.from_arrays([
            pa.array([ub], pa.int32()), pa.array([x.rows.astype("<i4").tobytes()], pa.binary()),
            one(x.ids.take(pa.array(x.rows))), one(items), one(pa.array(x.scores)),
            pa.array([x.needed()], pa.float64()), pa.array([x.met], pa.int64())],
            ["ub", "at", "user_id", "item_id", "score", "reach", "met"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists = None, None
        for batch in stream:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if row["ub"].as_py() != at:
                    if lists is not None:
                        yield state(at, lists)
                    at, lists = row["ub"].as_py(), _Lists(row, n, restricted)
                if row["ib"].is_valid:
                    lists.meet(row)
        if lists is not None:
            yield state(at, lists)

    return run


def top_items(
    user_factors: DataFrame,
    item_factors: DataFrame,
    n: int,
    seen: DataFrame,
    candidates: DataFrame | None = None,
    user_block: int = USER_BLOCK,
    item_block: int = ITEM_BLOCK,
    broadcast_bytes: int = BROADCAST_BYTES,
    observe: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """Best ``n`` items per user by inner product, seen items left out.

    Users stay where they are, with their seen items; the catalogue comes to them in chunks of blocks
    counted to be at most ``broadcast_bytes``, and block pairs out of reach are dropped. With
    ``candidates`` only those (user, item) pairs compete, and only they are multiplied. ``observe`` is
    told how many pairs of blocks were multiplied and how many there are.
    """
    spark = user_factors.sparkSession
    single = F.col("features").cast("array<float>")
    user_factors, item_factors = (f.withColumn("features", single)
                                  for f in (user_factors, item_factors))
    n_users, n_items = user_factors.count(), item_factors.count()
    n_u, n_i = max(1, -(-n_users // user_block)), max(1, -(-n_items // item_block))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(n_u, max(4 * spark.sparkContext.defaultParallelism, tasks))
    sized = item_factors.withColumn("size", _length(F.col("features")))
    items = durable(global_position(
        sized, [F.col("size").desc(), F.col("item_id")], "pos", start=0
    ).withColumn("ib", F.floor(F.col("pos") / item_block).cast("int")).select(
        "item_id", "features", "size", "pos", "ib"))
    users = durable(_user_blocks(
        user_factors, items.select("item_id", "pos"), n_u, parts, seen, candidates))
    blocks = durable(_item_blocks(items, min(n_i, tasks)))
    id_type, item_type = (f.schema[c].dataType for f, c in (
        (user_factors, "user_id"), (item_factors, "item_id")))
    schema = (f"ub int, at binary, user_id array<{id_type.simpleString()}>, "
              f"item_id array<{item_type.simpleString()}>, score array<double>, reach double, met long")
    width = item_factors.select(F.max(F.size("features"))).first()[0] or 1
    per_chunk = max(1, broadcast_bytes // (item_block * (4 * width + 16)))
    found, met = None, 0
    for start in range(0, n_i, per_chunk):
        if found is None:
            asked = users.withColumns({c: F.lit(None).cast(t) for c, t in (
                ("at", "binary"), ("item_id", f"array<{item_type.simpleString()}>"),
                ("score", "array<double>"), ("reach", "double"))})
        else:
            asked = users.join(found.select("ub", "at", "item_id", "score", "reach"), "ub")
        chunk = blocks.filter(F.col("ib").between(start, start + per_chunk - 1)).orderBy("ib")
        near = F.col("ib_top") * (1 + SLACK) >= F.coalesce("reach", F.lit(0.0))
        found = durable(asked.join(F.broadcast(chunk), near, "left").drop("reach").mapInArrow(
            _kernel(n, candidates is not None, to_arrow_type(item_type)), schema))
        met += found.agg(F.sum("met")).first()[0] or 0
    if observe:
        observe(met, n_u * n_i)
    return found.select(F.explode(F.arrays_zip("user_id", "item_id", "score")).alias("e")).select(
        "e.user_id", "e.item_id", "e.score")
