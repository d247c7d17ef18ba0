"""Token ids as canonical, length-limited Huffman codes in independent blocks.

A file set has three Parquet tables: ``codebook`` (id, code length), ``blocks`` (payload bits of
whole documents, with the bit offset of every ``LANE`` tokens) and, inside the blocks, the document
ids and sizes. Blocks follow each other in ascending document order: ``part`` first, then ``block``.
A block decodes by itself: all its checkpoints advance together, one table look-up per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import tokens
from .common import fresh_path, partitions, slices, stored

# Tokens between two checkpoints and, about, in a block. A block ends with a document.
LANE = 256
BLOCK_TOKENS = 1 << 18
# Longest code: 16 bits, or one more than a plain number of a larger vocabulary takes.
CODE_BITS = 16
# Id that ends every document.
END_ID = 1


# -- codes -----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``limit`` bits (package-merge).

    ``counts`` are positive; a lone symbol gets one bit.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit into codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, dtype=np.float64)[order]
    items, is_leaf = leaves, []
    for _ in range(limit):
        is_leaf.append(None)
        if len(is_leaf) == 1:
            is_leaf[0] = np.ones(n, dtype=bool)
            continue
        pairs = len(items) // 2
        packages = items[0:2 * pairs:2] + items[1:2 * pairs:2]
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        items, is_leaf[-1] = both[rank], rank < n
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for level in reversed(is_leaf):
        own = int(level[:take].sum())
        lengths[:own] += 1
        take = 2 * (min(take, len(level)) - own)
    out = np.empty(n, dtype=np.uint8)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol): each one more than the last, shifted to its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code, last = 0, 0
    for i in order:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Codebook:
    """Encoding arrays by id and one decoding table over the longest code's bits."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.uint8)
        self.bits = max(int(self.lengths.max(initial=1)), 1)
        codes = canonical_codes(self.lengths)
        size = int(self.ids.max(initial=0)) + 1
        self.code_of = np.zeros(size, dtype=np.uint32)
        self.length_of = np.zeros(size, dtype=np.uint8)
        self.code_of[self.ids], self.length_of[self.ids] = codes, self.lengths
        shift = (self.bits - self.lengths).astype(np.int64)
        start, span = codes.astype(np.int64) << shift, np.left_shift(1, shift)
        entry = (self.ids << 5) | self.lengths
        self.table = np.zeros(1 << self.bits, dtype=np.int64)
        rank = np.argsort(start)
        filled = np.repeat(entry[rank], span[rank])
        self.table[:len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every ``LANE``-th token."""
        length = self.length_of[ids].astype(np.int64)
        end = np.cumsum(length)
        at = end - length
        value = self.code_of[ids].astype(np.uint64) << (64 - length - (at & 31)).astype(np.uint64)
        word, n = at >> 5, (int(end[-1]) >> 5) + 2
        # Codes do not overlap, so sums of their shifted halves are exact below 2**32.
        total = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        total += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        payload = total.astype(np.uint32).astype(">u4").tobytes()
        return payload[:(int(end[-1]) + 7) // 8], at[::LANE].astype("<u8")

    def decode(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block, all lanes in step."""
        raw = np.frombuffer(payload + bytes(LANE * self.bits // 8 + 8), dtype=np.uint8)
        window = np.zeros(len(raw) - 3, dtype=np.int64)
        for k in range(4):
            window |= raw[k:len(raw) - 3 + k].astype(np.int64) << (24 - 8 * k)
        at = offsets.astype(np.int64)
        out = np.empty((LANE, len(at)), dtype=np.uint32)
        mask, top = (1 << self.bits) - 1, 32 - self.bits
        last = len(window) - 1
        for k in range(LANE):
            entry = self.table[(window[np.minimum(at >> 3, last)] >> (top - (at & 7))) & mask]
            out[k] = entry >> 5
            at += entry & 31
        return out.T.reshape(-1)[:n]


# -- tokens ----------------------------------------------------------------------------------------

TOKENS = "doc_id long, tie long, n_tokens long, ids binary"


def _encode_texts(vocabulary: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        codec = pa.Codec("zstd", compression_level=1)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in slices(stream):
            ns, packed = [], []
            for ids in enc.encode_all(batch.column("text").to_pylist()):
                ids += end
                ns.append(len(ids) // 4)
                packed.append(codec.compress(ids, asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(ns, pa.int64()),
                 pa.array(packed, pa.binary())], ["doc_id", "tie", "n_tokens", "ids"])

    return run


def token_table(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Stored ids of every text with the end id: ``doc_id, tie, n_tokens, ids`` (ids compressed)."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.col("text"))
    return stored(texts.mapInArrow(_encode_texts(vocabulary), TOKENS), "tokens")


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), dtype="<u4")


def _count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, dtype=np.int64)
    for batch in stream:
        for packed, n in zip(batch.column("ids"), batch.column("n_tokens"), strict=True):
            found = np.bincount(_unpack(packed.as_py(), n.as_py()))
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[:len(found)] += found
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def fit_codebook(ids: DataFrame, limit: int = CODE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and code lengths from their counts over all documents; at most one row per vocabulary
    entry reaches the driver."""
    rows = ids.select("ids", "n_tokens").mapInArrow(_count, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")).orderBy("id").toPandas()
    counts = rows["n"].to_numpy()
    bits = max(limit, int(len(counts)).bit_length() + 1)
    return rows["id"].to_numpy(), code_lengths(counts, bits)


# -- files -----------------------------------------------------------------------------------------

BLOCKS = ("part int, block int, n_tokens long, doc_ids array<long>, sizes array<long>, "
          "offsets binary, payload binary")


def _block_writer(ids: np.ndarray, lengths: np.ndarray):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(ids, lengths)
        part, block = TaskContext.get().partitionId(), 0
        docs: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                            ("offsets", pa.binary()), ("payload", pa.binary())])

        def block_row() -> pa.RecordBatch:
            payload, offsets = book.encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(
                    (part, block, sum(sizes), docs, sizes, offsets.tobytes(), payload),
                    schema.types, strict=True)], schema=schema)

        total = 0
        for batch in stream:
            for doc, n, packed in zip(batch.column("doc_id"), batch.column("n_tokens"),
                                      batch.column("ids"), strict=True):
                docs.append(doc.as_py())
                sizes.append(n.as_py())
                held.append(_unpack(packed.as_py(), n.as_py()))
                total += n.as_py()
                if total >= BLOCK_TOKENS:
                    yield block_row()
                    block, docs, sizes, held, total = block + 1, [], [], [], 0
        if docs:
            yield block_row()

    return run


def write_files(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json",
                limit: int = CODE_BITS) -> None:
    """Encode every text and write the file set below ``path`` in ascending ``doc_id`` order.

    Null texts are empty and still end with the end id; null ids come first; equal ids follow each
    other by a hash of their texts. No rows write empty tables. Other columns are ignored.
    """
    spark = docs.sparkSession
    ids = token_table(docs, vocabulary)
    symbols, lengths = fit_codebook(ids, limit)
    spark.createDataFrame(
        [(int(s), int(n)) for s, n in zip(symbols, lengths, strict=True)], "id long, bits int"
    ).coalesce(1).write.parquet(f"{path}/codebook")
    ordered = ids.repartitionByRange(partitions(ids), "doc_id", "tie").sortWithinPartitions(
        "doc_id", "tie")
    ordered.select("doc_id", "n_tokens", "ids").mapInArrow(
        _block_writer(symbols, lengths), BLOCKS).write.parquet(f"{path}/blocks")


DECODED = "part int, block int, place int, doc_id long, before long, n_tokens long, ids binary"


def _block_reader(ids: np.ndarray, lengths: np.ndarray):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(ids, lengths)
        for batch in stream:
            for row in range(batch.num_rows):
                b = {c: batch.column(c)[row].as_py()
                     for c in ("part", "block", "n_tokens", "doc_ids", "sizes", "offsets",
                               "payload")}
                found = book.decode(b["payload"], np.frombuffer(b["offsets"], "<u8"), b["n_tokens"])
                raw = memoryview(found.astype("<u4").tobytes())
                sizes = np.asarray(b["sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, b["part"], np.int32)),
                    pa.array(np.full(n, b["block"], np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(b["doc_ids"], pa.int64()),
                    pa.array(ends - sizes), pa.array(sizes),
                    pa.array([bytes(raw[4 * (e - s):4 * e]) for s, e in zip(
                        sizes.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ], ["part", "block", "place", "doc_id", "before", "n_tokens", "ids"])

    return run


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``part, block, place, doc_id, before, n_tokens, ids``: the ids of every document, and how
    many ids its block has before it."""
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toPandas()
    if not len(book):
        return spark.createDataFrame([], DECODED)
    # A block fills an Arrow batch of its own or shares it with few others.
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(
        _block_reader(book["id"].to_numpy(), book["bits"].to_numpy()), DECODED)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each block of the file set: ``part, block, start``."""
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "block", "n_tokens")
    # One row per part meets in one task: a part holds at least a scan's share of documents.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(
        "part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    return sizes.withColumn("inside", inside).join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.col("inside")).alias("start"))


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Rows of :func:`read_files`, without ``ids`` or with something narrow in their place, with
    ``start``, the ids of all documents before, instead of their place in the files."""
    starts = block_starts(rows.sparkSession, path)
    keep = [c for c in rows.columns if c not in ("part", "block", "place", "before", "doc_id")]
    return rows.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), *keep)


def roundtrip(docs: DataFrame, vocabulary: str = "word_bpe_49k.json",
              derive=lambda decoded: decoded) -> DataFrame:
    """Write the file set below the shared folder and read it back: ``doc_id, start, n_tokens,
    ids``, one row per row of ``docs``. ``derive`` may put a digest in the place of ``ids`` before
    rows are moved to get their starts."""
    spark = docs.sparkSession
    path = fresh_path(spark, "huffman")
    write_files(docs, path, vocabulary)
    return with_starts(derive(read_files(spark, path)), path)
