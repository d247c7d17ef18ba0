"""Exact deduplication by Patricia tries that own every distinct text.

Rows are first collapsed where they lie: each task inserts the full byte strings of its rows into a
compressed radix trie whose terminals keep one owner and a count. What is left, one row per distinct
text and task, is shuffled by (length, content hash), sorted by that key and collapsed the same way.
A group of copies of any size thus reaches its owner as few rows per task.

A trie whose texts exceed ``TRIE_BYTES`` spills by subtree, the heaviest first, until half is free. On
the map side terminals that met a copy stay, as far as they fit, and go on absorbing copies; the second
pass merges what was spilled. On the reduce side keys come sorted, so all subtrees are finished once
the key changes. Rows are held for owners only: rows that lost their place, and copies, are dropped
when they outweigh the trie, so a text that comes back from every task costs its owner's row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices

# Bytes of text that a task's trie may hold before it spills subtrees.
TRIE_BYTES = 12 << 20


class _Node:
    __slots__ = ("kids", "label", "owner")

    def __init__(self, label: bytes):
        self.label = label
        self.kids: dict[int, _Node] = {}
        self.owner: list | None = None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Bytes that ``a`` has in common with ``b`` from ``at`` on, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal node keeps ``[id, count, place, size]``."""

    def __init__(self):
        self.root = _Node(b"")
        self.size = 0  # bytes of all texts

    @staticmethod
    def below(node: _Node) -> list[_Node]:
        """Terminal nodes of a subtree."""
        found, todo = [], [node]
        while todo:
            node = todo.pop()
            if node.owner is not None:
                found.append(node)
            todo.extend(node.kids.values())
        return found

    @property
    def terminals(self) -> list[_Node]:
        return self.below(self.root)

    def cut(self) -> list[list]:
        """Take the heaviest subtree off the topmost fork; the owners it held, with their keys."""
        top, key = self.root, b""
        while top.owner is None and len(top.kids) == 1:
            (top,) = top.kids.values()
            key += top.label
        weights = {b: sum(t.owner[3] for t in self.below(kid)) for b, kid in top.kids.items()}
        if not weights:  # the only text
            owners, self.root, self.size = [[key, *top.owner]], _Node(b""), 0
            return owners
        kid = top.kids.pop(max(weights, key=weights.get))
        self.size -= max(weights.values())
        found, todo = [], [(kid, key + kid.label)]
        while todo:
            node, at = todo.pop()
            if node.owner is not None:
                found.append([at, *node.owner])
            todo.extend((k, at + k.label) for k in node.kids.values())
        return found

    def terminal(self, key: bytes) -> _Node:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                leaf = _Node(key[at:])
                node.kids[key[at]] = leaf
                return leaf
            if key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            m = _shared(kid.label, key, at)
            fork = _Node(kid.label[:m])
            node.kids[key[at]] = fork
            kid.label = kid.label[m:]
            fork.kids[kid.label[0]] = kid
            node, at = fork, at + m
        return node

    def insert(self, key: bytes, row_id, count: int, place, largest: bool) -> None:
        """Count the row and let it own its text if its id is better; ids that are null lose."""
        node = self.terminal(key)
        if node.owner is None:
            node.owner = [row_id, count, place, len(key)]
            self.size += len(key)
            return
        own = node.owner
        own[1] += count
        if row_id is not None and (
            own[0] is None or (row_id > own[0] if largest else row_id < own[0])
        ):
            own[0], own[2] = row_id, place


def _collapse(largest: bool, sorted_keys: bool):
    """Rows with ``_id, _text, _key, _n`` in, owners with their groups' counts out."""

    def rows_of(held: list[pa.RecordBatch], found: list) -> Iterator[pa.RecordBatch]:
        """Rows of owners ``(place, count)``, batch by batch."""
        by_batch: dict[int, list] = {}
        for (b, r), n in found:
            by_batch.setdefault(b, []).append((r, n))
        for b, rows in sorted(by_batch.items()):
            rows.sort()
            out = held[b].take(pa.array([r for r, _ in rows], pa.int64()))
            at = out.schema.get_field_index("_n")
            yield out.set_column(at, out.schema.field(at), pa.array([n for _, n in rows], pa.int64()))

    def kept(held: list[pa.RecordBatch], trie: PatriciaTrie) -> list[pa.RecordBatch]:
        """The rows of the trie's owners alone, their places brought up to date."""
        by_batch: dict[int, list] = {}
        for t in trie.terminals:
            by_batch.setdefault(t.owner[2][0], []).append(t)
        out = []
        for b, nodes in by_batch.items():
            out.append(held[b].take(pa.array([t.owner[2][1] for t in nodes], pa.int64())))
            for r, t in enumerate(nodes):
                t.owner[2] = (len(out) - 1, r)
        return out

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        trie, weight, last = PatriciaTrie(), 0, None
        for whole in slices(stream):
            names = whole.schema.get_field_index
            ids, texts, keys, counts = (
                whole.column(names(c)).to_pylist() for c in ("_id", "_text", "_key", "_n"))
            held.append(whole)
            weight += whole.nbytes
            for i, text in enumerate(texts):
                if trie.size > TRIE_BYTES and (not sorted_keys or keys[i] != last):
                    if sorted_keys:
                        found, trie = [(t.owner[2], t.owner[1]) for t in trie.terminals], PatriciaTrie()
                    else:
                        found = _spilled(trie)
                    yield from rows_of(held, found)
                    held = [*kept(held, trie), whole]
                    weight = sum(b.nbytes for b in held)
                trie.insert(text.encode("utf-8", "surrogatepass"), ids[i], counts[i],
                            (len(held) - 1, i), largest)
                last = keys[i]
            if weight > 4 * TRIE_BYTES:
                held = kept(held, trie)
                weight = sum(b.nbytes for b in held)
        yield from rows_of(held, [(t.owner[2], t.owner[1]) for t in trie.terminals])

    return run


def _spilled(trie: PatriciaTrie) -> list[tuple]:
    """``(place, count)`` of the owners that leave a trie, subtree by subtree, until half is free.
    Texts that met a copy go back, if that leaves a quarter free."""
    out, again, back = [], [], 0
    while trie.size > TRIE_BYTES // 2:
        for key, row_id, count, place, size in trie.cut():
            if count > 1 and back + size <= TRIE_BYTES // 4:
                again.append((key, row_id, count, place))
                back += size
            else:
                out.append((place, count))
    for key, row_id, count, place in again:
        trie.insert(key, row_id, count, place, True)
    return out


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           keep: str = "largest") -> DataFrame:
    """The row that stays of every group of equal texts, with all its columns and ``group_size``.

    Texts are equal when their bytes are; null counts as empty. The row with the largest (or
    smallest) id stays, any row with an id before one without; of rows that repeat id and text one
    stays. No rows give no rows. A column of the input named ``group_size`` is replaced.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    payload = [c for c in docs.columns if c != "group_size"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in payload]).alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        text.alias("_text"),
        F.xxhash64(F.octet_length(text), text).alias("_key"),
        F.lit(1).cast("long").alias("_n"),
    )
    # The text travels once, as the key column; it is put back into the row at the end.
    bare = rows.withColumn("_row", F.col("_row").withField(f"`{text_col}`", F.when(
        F.col(f"_row.`{text_col}`").isNotNull(), F.lit(""))))
    schema = T.StructType(bare.schema.fields)
    local = bare.mapInArrow(_collapse(keep == "largest", False), schema)
    dealt = local.repartition("_key").sortWithinPartitions("_key")
    final = dealt.mapInArrow(_collapse(keep == "largest", True), schema)
    return final.select(
        *[
            F.when(F.col(f"_row.`{c}`").isNotNull(), F.col("_text")).alias(c)
            if c == text_col else F.col(f"_row.`{c}`").alias(c)
            for c in payload
        ],
        F.col("_n").alias("group_size"),
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``kept`` marks the rows whose id is the owner's; rows that repeat id and text are all marked
    alike. A group without any id has a null ``keep_id`` and keeps its rows. Extra columns are
    ignored, no rows give no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bare = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kept = owners(bare, keep=keep).select(
        F.col("doc_id").alias("keep_id"), "group_size",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
        .join(kept, "text_sha256")
        .select("doc_id", "keep_id", "group_size",
                F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
