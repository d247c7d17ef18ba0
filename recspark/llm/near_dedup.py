"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets of which each shares at least ``need = ceil(0.8 * size)`` shingles with the other have at
least ``l`` shingles in common among the first ``size - need + l`` of each, in any fixed order of
all shingles. A longer prefix (larger ``l``) makes more postings but lets a pair through only with
``l`` shared ones.

1. Every text is hashed once. Its prefix in hash order, with ``l`` a tenth of its size, is packed
   into one row per task and hash range; ranges find prefix shingles that more than one text has, and
   texts with fewer such shingles than their smallest possible partner demands are done.
2. The others, once per distinct set, are counted shingle by shingle. Sets of which more than a
   fifth is unique to them are done. The rest order their shingles by frequency and choose ``l`` by
   the estimated cost of their candidates.
3. Sets that meet in a posting list are first verified against one pivot of the list each, so a
   large group of near copies joins up with a row per member. All pairs of a list whose sets still
   lie in different components are then compared, so no link between components is missed; pairs
   inside a component cannot change it. Short lists are joined, matches counted and candidates
   verified. Lists longer than ``HOT`` are cut into blocks; a task compares two blocks by matrix
   products and returns no more rows than they have sets. A pair of such sets is compared in the
   first long list that both are in, and sets travel only to lists in which they have such a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import partitions, slices, stored
from .components import components
from .words import batches, shingle_sets

WIDTH = 5
# Jaccard similarity of at least 4 / 5.
TOP, BASE = 4, 5
# Prefix shingles that a task holds before it packs them.
PACK = 2_000_000
# Pivot rounds go on while they help and the pairs left exceed this many per posting.
PAIRS_PER_POSTING = 2
MAX_ROUNDS = 3
# Longest posting list that is joined row by row, sets of a block, and shingles per product.
HOT = 64
BLOCK = 1024
PRODUCT = 4096


def need(n):
    """Shingles that a partner must share, at least: ``ceil(4 n / 5)`` for ints and arrays."""
    return (TOP * n + BASE - 1) // BASE


def first_matches(n):
    """``l`` of the first prefix."""
    return np.minimum(need(n), 1 + n // 10)


# -- 1: texts to prefix ranges -----------------------------------------------------------------------

SKETCH = ("part int, place int, doc_id long, n long, sig binary, "
          "range int, low binary, places binary")
_SKETCH = pa.schema([
    ("part", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()),
    ("sig", pa.binary()), ("range", pa.int32()), ("low", pa.binary()), ("places", pa.binary())])


def signature(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _sketch(ranges: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        owner: list[tuple[int, int]] = []
        seen: set[bytes] = set()

        def rows(**cols) -> pa.RecordBatch:
            size = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type)
                 for f in _SKETCH], schema=_SKETCH)

        def pack() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            places = np.repeat(np.array([p for p, _ in owner], dtype="<u4"),
                               [n for _, n in owner])
            where = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(ranges + 1))
            low = tokens[order].astype("<u4")
            places = places[order]
            full = np.flatnonzero(np.diff(edges))
            cut = [(int(edges[r]), int(edges[r + 1])) for r in full]
            return rows(part=np.full(len(full), part), range=full,
                        low=[low[a:b].tobytes() for a, b in cut],
                        places=[places[a:b].tobytes() for a, b in cut])

        total = 0
        for batch in slices(stream):
            ids = batch.column("doc_id").to_pylist()
            at, ns, sigs = 0, [], []
            for texts in batches(batch.column("text").to_pylist()):
                for tokens in shingle_sets(texts, WIDTH):
                    n = len(tokens)
                    sig = signature(tokens)
                    ns.append(n)
                    sigs.append(sig)
                    # Equal sets of one task go once; of several tasks they all go on to step 2.
                    if n and sig not in seen:
                        seen.add(sig)
                        prefix = tokens[:n - need(n) + int(first_matches(n))]
                        held.append(prefix)
                        owner.append((place + at, len(prefix)))
                        total += len(prefix)
                    at += 1
            yield rows(part=np.full(len(ids), part), place=place + np.arange(len(ids)),
                       doc_id=ids, n=ns, sig=sigs)
            place += len(ids)
            if total >= PACK:
                yield pack()
                held, owner, total = [], [], 0
        if held:
            yield pack()

    return run


HITS = "part int, places binary, hits binary"


def _shared(table: pa.Table) -> pa.Table:
    """Of one hash range: how many of its shingles every text shares with another one."""
    parts = table.column("part").to_numpy()
    low = [np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()]
    text = np.concatenate([
        (np.uint64(p) << np.uint64(32)) | np.frombuffer(x, "<u4").astype(np.uint64)
        for p, x in zip(parts, table.column("places").to_pylist(), strict=True)])
    low = np.concatenate(low)
    order = np.argsort(low, kind="stable")
    s = low[order]
    again = s[1:] == s[:-1]
    shared = np.concatenate((again, [False])) | np.concatenate(([False], again))
    found, hits = np.unique(text[order][shared], return_counts=True)
    owner = (found >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
    ends = [*at[1:], len(owner)] if len(owner) else []
    places = found.astype("<u4")
    hits = hits.astype("<u4")
    return pa.table({
        "part": pa.array([int(owner[a]) for a in at], pa.int32()),
        "places": pa.array([places[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
        "hits": pa.array([hits[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})


def _survivors(table: pa.Table) -> pa.Table:
    """Of one part: its texts that share enough of their prefixes."""
    is_hit = np.asarray(table.column("hits").is_valid())
    docs, hits = table.filter(pa.array(~is_hit)), table.filter(pa.array(is_hit))
    place = docs.column("place").to_numpy()
    total = np.zeros(int(place.max(initial=-1)) + 1, dtype=np.int64)
    for p, h in zip(hits.column("places").to_pylist(), hits.column("hits").to_pylist(),
                    strict=True):
        total[np.frombuffer(p, "<u4")] += np.frombuffer(h, "<u4")
    n = docs.column("n").to_numpy()
    # A partner has at least need(n) shingles, and with its size its own l may be smaller.
    enough = np.minimum(first_matches(n), first_matches(need(n)))
    keep = (n > 0) & (total[place] >= enough) if len(n) else np.zeros(0, dtype=bool)
    return docs.filter(pa.array(keep)).select(["doc_id", "sig"])


def sketches(docs: DataFrame) -> DataFrame:
    """Stored rows of step 1: one per text (``range`` null) and one per task and range."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return stored(texts.mapInArrow(_sketch(max(8, partitions(texts))), SKETCH), "sketch")


def survivors(sketch: DataFrame) -> DataFrame:
    """``sig, doc_id`` of the sets that may have a partner other than an equal set."""
    packed = sketch.filter(F.col("range").isNotNull()).select("range", "part", "low", "places")
    hits = packed.groupBy("range").applyInArrow(_shared, HITS)
    texts = sketch.filter(F.col("range").isNull()).select(
        "part", "place", "doc_id", "n", "sig", F.lit(None).cast("binary").alias("places"),
        F.lit(None).cast("binary").alias("hits"))
    cols = ["part", "place", "doc_id", "n", "sig", "places", "hits"]
    both = texts.unionByName(hits.withColumns({
        "place": F.lit(None).cast("int"), "doc_id": F.lit(None).cast("long"),
        "n": F.lit(None).cast("long"), "sig": F.lit(None).cast("binary")}).select(*cols))
    alive = both.groupBy("part").applyInArrow(_survivors, "doc_id long, sig binary")
    return alive.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))


# -- 2: sets and postings ----------------------------------------------------------------------------


def _full_sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(stream):
        for texts in batches(batch.column("text").to_pylist()):
            found = list(shingle_sets(texts, WIDTH))
            yield pa.RecordBatch.from_arrays(
                [pa.array([signature(t) for t in found], pa.binary()),
                 pa.array([len(t) for t in found], pa.int64()),
                 pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64()))],
                ["sig", "n", "tokens"])


def token_sets(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """Stored ``node, sig, n, tokens`` of the distinct sets of the surviving texts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).alias("d")
    a = alive.select(F.col("doc_id")).distinct().alias("a")
    texts = d.join(a, F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")), "left_semi")
    sets = texts.mapInArrow(_full_sets, "sig binary, n long, tokens array<long>")
    return stored(sets.filter("n > 0").dropDuplicates(["sig"]).select(
        F.monotonically_increasing_id().alias("node"), "sig", "n", "tokens"), "sets")


def _need(n: str = "n"):
    return F.floor((F.col(n) * TOP + BASE - 1) / BASE)


def postings(sets: DataFrame) -> DataFrame:
    """Stored ``token, node, n, ell, rank``: the prefix of every set that may have a partner.

    ``ell`` is the set's number of matches and ``rank`` the smallest ``l`` whose prefix holds the
    token. Extending the prefix to ``l`` costs its postings' lengths, and about a ``l``-th of those
    rows are candidates whose ``n`` shingles must be compared.
    """
    flat = sets.select("node", "n", F.explode("tokens").alias("token"))
    df = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = stored(flat.join(df, "token"), "shared")
    kept = shared.groupBy("node").agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n"))
    kept = kept.filter(F.col("common") >= _need()).select("node", "common")
    by_node = W.partitionBy("node")
    order = by_node.orderBy("df", "token")
    ranked = shared.join(kept, "node").withColumns({
        "at": F.row_number().over(order) + F.col("n") - F.col("common"),
        "cost": F.sum(F.col("df") - 1).over(order.rowsBetween(W.unboundedPreceding, 0)),
    }).withColumn("l", F.col("at") - (F.col("n") - _need())).filter(
        F.col("l") <= F.least(_need(), 1 + F.floor(F.col("n") / 5)))
    choice = F.when(F.col("l") >= 1, F.struct(
        (F.col("cost") * (1 + F.col("n") / F.col("l"))).alias("cost"), F.col("l")))
    chosen = ranked.withColumn("ell", F.min(choice).over(by_node)["l"]).filter("l <= ell")
    return stored(chosen.select("token", "node", "n", "ell",
                                F.greatest("l", F.lit(1)).alias("rank")), "postings")


# -- 3: links ----------------------------------------------------------------------------------------


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with a Jaccard similarity of 0.8 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").withColumn("both", both).filter(
        F.col("both") * BASE >= (F.size("ta") + F.size("tb") - F.col("both")) * TOP
    ).select("a", "b")


def _labelled(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posts.withColumn("label", F.col("node"))
    return posts.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))


def _lists(posts: DataFrame, turn: int) -> DataFrame:
    """Per token with more than one component: pairs left, and a pivot of its largest component."""
    inside = posts.groupBy("token", "label").agg(
        F.count(F.lit(1)).alias("m"),
        F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
    return inside.groupBy("token").agg(
        (F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("left"),
        F.max_by(F.struct("label", "pivot"), F.struct(
            "m", -F.xxhash64("pivot", F.lit(turn)))).alias("top"),
    ).filter("left > 0").select(
        "token", (F.col("left") / 2).alias("left"), F.col("top.label").alias("top_label"),
        F.col("top.pivot").alias("pivot"))


def _fits(n: str, m: str):
    return F.least(n, m) * BASE >= F.greatest(n, m) * TOP


def linked(sets: DataFrame, posts: DataFrame) -> DataFrame | None:
    """``node, label``: components of the sets; sets without a link may be missing."""
    size = posts.count()
    labels, links, tried, last = None, None, None, None

    def grow(pairs: DataFrame) -> bool:
        """Verify new pairs and join what they link; whether any did."""
        nonlocal labels, links, tried
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        fresh = stored(fresh, "pairs")
        tried = fresh if tried is None else tried.unionByName(fresh)
        found = stored(verified(fresh, sets), "links")
        if not found.take(1):
            return False
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        return True

    if not size:
        return None
    sizes = sets.select(F.col("node").alias("pivot"), F.col("n").alias("m"))
    for turn in range(MAX_ROUNDS):
        now = _labelled(posts, labels)
        lists = stored(_lists(now, turn), "lists")
        left = lists.agg(F.sum("left").alias("n")).first()["n"] or 0
        if left <= PAIRS_PER_POSTING * size or (last is not None and left > 0.7 * last):
            break
        last = left
        rows = now.join(lists, "token").filter("label <> top_label").join(sizes, "pivot").filter(
            _fits("n", "m"))
        if not grow(rows.select(F.least("node", "pivot").alias("a"),
                                F.greatest("node", "pivot").alias("b")).distinct()):
            break
    now = _labelled(posts, labels)
    now = stored(now.join(_lists(now, 0).select("token"), "token", "left_semi"), "open")
    long = now.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT)
    grow(_short_pairs(now.join(long, "token", "left_anti")))
    found = stored(_long_links(now.join(long, "token"), sets), "links")
    if found.take(1):
        labels = components(found if links is None else links.unionByName(found))
    return labels


def _short_pairs(posts: DataFrame) -> DataFrame:
    """Candidates ``a, b`` with enough matches in short lists, from different components."""
    cols = ("node", "n", "ell", "rank", "label")
    x = posts.select("token", *[F.col(c).alias(f"{c}_x") for c in cols])
    y = posts.select("token", *[F.col(c).alias(f"{c}_y") for c in cols])
    ell = F.least("ell_x", "ell_y")
    met = x.join(y, "token").filter(
        (F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y"))
        & (F.col("rank_x") <= ell) & (F.col("rank_y") <= ell) & _fits("n_x", "n_y"))
    return met.groupBy(F.col("node_x").alias("a"), F.col("node_y").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.min(ell).alias("ell")
    ).filter("c >= ell").select("a", "b")


def _in_block_pairs(rows: DataFrame) -> DataFrame:
    """Rows with ``token, node`` copied to every pair ``i <= j`` of their list's blocks."""
    count = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return rows.join(count, "token").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop(
        "other", "blocks")


def _incidence(lists: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """0/1 rows: which of the sorted ``columns`` each sorted list holds."""
    out = np.zeros((len(lists), len(columns)), dtype=np.float32)
    if len(columns):
        for row, have in zip(out, lists, strict=True):
            at = np.minimum(np.searchsorted(columns, have), len(columns) - 1)
            row[at[columns[at] == have]] = 1
    return out


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``x`` with all ``y``."""
    total = np.zeros((len(x), len(y)), dtype=np.float32)
    if x and y:
        both = np.intersect1d(np.concatenate(x), np.concatenate(y))
        for k in range(0, len(both), PRODUCT):
            part = both[k:k + PRODUCT]
            total += _incidence(x, part) @ _incidence(y, part).T
    return total


def _open_pairs(table: pa.Table):
    """Rows of the two blocks of a group, and which of their pairs this list must compare."""
    token, i, j = (table.column(c)[0].as_py() for c in ("token", "i", "j"))
    own = table.column("own").to_numpy()
    label, n = table.column("label").to_numpy(), table.column("n").to_numpy()
    node = table.column("node").to_numpy()
    earlier = [np.asarray(h, dtype=np.int64) for h in table.column("hots").to_pylist()]
    earlier = [h[h < token] for h in earlier]
    x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
    open_ = (label[x][:, None] != label[y]) & (
        np.minimum(n[x][:, None], n[y]) * BASE >= np.maximum(n[x][:, None], n[y]) * TOP)
    if i == j:
        open_ &= node[x][:, None] < node[y]
    if open_.any():
        open_ &= _shared_counts([earlier[k] for k in x], [earlier[k] for k in y]) == 0
    return x, y, open_


def _needed(table: pa.Table) -> pa.Table:
    x, y, open_ = _open_pairs(table)
    at = np.unique(np.concatenate((x[open_.any(axis=1)], y[open_.any(axis=0)])))
    return table.select(["token", "node"]).take(pa.array(at))


def _block_links(table: pa.Table) -> pa.Table:
    """Links that join different components of two blocks, one for each join."""
    x, y, open_ = _open_pairs(table)
    a, b = [], []
    if open_.any():
        x, y, open_ = x[open_.any(axis=1)], y[open_.any(axis=0)], open_[
            np.ix_(open_.any(axis=1), open_.any(axis=0))]
        sets = table.column("tokens")
        get = lambda rows: [sets[int(k)].values.to_numpy() for k in rows]
        n, node, label = (table.column(c).to_numpy() for c in ("n", "node", "label"))
        both = _shared_counts([np.sort(t) for t in get(x)],
                              [np.sort(t) for t in get(y)]).astype(np.int64)
        linked = open_ & (both * BASE >= (n[x][:, None] + n[y] - both) * TOP)
        up = {k: k for k in label.tolist()}

        def root(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for p, q in np.argwhere(linked).tolist():
            r, t = root(int(label[x[p]])), root(int(label[y[q]]))
            if r != t:
                up[max(r, t)] = min(r, t)
                a.append(int(node[x[p]]))
                b.append(int(node[y[q]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _long_links(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components among the sets of long lists."""
    hots = posts.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("hots"))
    rows = stored(posts.select("token", "node", "label", "n").join(hots, "node"), "long-lists")
    needed = _in_block_pairs(rows).groupBy("token", "i", "j").applyInArrow(
        _needed, "token long, node long").distinct()
    held = rows.join(stored(needed, "needed"), ["token", "node"]).join(
        sets.select("node", "tokens"), "node")
    return _in_block_pairs(held).groupBy("token", "i", "j").applyInArrow(
        _block_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``.

    Shingles are five consecutive words with A-Z in lower case, fewer words are one shingle. Texts
    link at a Jaccard similarity of 0.8 or more; a component is named by its smallest id. Null and
    empty texts have no shingle and no link. Rows without an id take part and cannot name a
    component (null if no member has an id). Rows that repeat id and text share all. Other columns
    are ignored; no rows give no rows. Shingles are compared by 64-bit hashes and equal sets found
    by 128-bit ones.
    """
    sketch = sketches(docs)
    texts = sketch.filter(F.col("range").isNull()).select("doc_id", "n", "sig")
    sets = token_sets(docs, survivors(sketch))
    labels = linked(sets, postings(sets))
    names = texts.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"))
    if labels is not None:
        members = stored(sets.select("sig", "node").join(labels, "node").join(names, "sig").select(
            "sig", "label", "first"), "members")
        of_label = members.groupBy("label").agg(F.min("first").alias("component"))
        joined = members.join(of_label, "label").select("sig", "component")
        names = names.join(joined, "sig", "left").select(
            "sig", F.coalesce("component", "first").alias("first"))
    return texts.join(names, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with their own columns.

    Rows without an id stay. The ids that go are a small list next to the texts: whether it is sent
    to the texts or both are shuffled is left to its measured size.
    """
    found = near_duplicates(docs)
    gone = stored(found.filter(F.col("doc_id") != F.col("component_id")).select(
        "doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
