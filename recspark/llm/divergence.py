"""How far the sources of a language diverge from each other and from the language as a whole.

Terms are counted in NumPy where the texts lie. Length buckets decide how a term is held: up to 8
bytes it is one unsigned 64-bit word, up to 16 bytes two, and longer terms are fixed-width byte rows
in one bucket per power of two. Words are sorted by radix, 16 bits at a time, byte rows byte by byte
in a bucket of their own, and equal neighbours are counted as runs. Tasks hand over one row per
(language, source, term) they saw; Spark adds them up, keeps the terms in enough documents of their
language, and compares the groups in whole numbers.

Shares are ``1 + floor(SCALE * (count + 1) / (total + terms))`` and a term's divergence is
``floor((p - q)^2 / q)``, both exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200

# Text that one counting step looks at, and distinct entries (of 16 bytes, longer terms count more) a
# task keeps before it hands them over.
STEP_BYTES = 2 << 20
HELD = 400_000

COUNTS = "lang string, source string, term string, n long, docs long"

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[0x80:] = True
_IN_TERM[ord("a"):ord("z") + 1] = True
_IN_TERM[ord("A"):ord("Z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by unsigned words, the last one leading: 16-bit digits, lowest first."""
    order = None
    for word in words:
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if not len(digit) or (digit == digit[0]).all():
                continue
            if order is None:
                order = np.argsort(digit, kind="stable")
            else:
                order = order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(words[0])) if order is None else order


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pack(raw: np.ndarray, at: np.ndarray, length: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of up to ``8 * words`` bytes as big-endian words, zeros behind; the last word leads."""
    out = []
    for w in range(words):
        value = np.zeros(len(at), dtype=np.uint64)
        for k in range(8 * w, 8 * w + 8):
            byte = np.where(k < length, raw[np.minimum(at + k, len(raw) - 1)], 0)
            value = (value << np.uint64(8)) | byte.astype(np.uint64)
        out.append(value)
    return out[::-1]


def _byte_rows(raw: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Terms of up to ``width`` bytes as rows of bytes, zeros behind."""
    rows = np.zeros((len(at), width), dtype=np.uint8)
    inside = np.arange(width) < length[:, None]
    rows[inside] = raw[(at[:, None] + np.arange(width))[inside]] if width * len(at) < STEP_BYTES \
        else np.concatenate([raw[a:a + n] for a, n in zip(at, length, strict=True)])
    return rows.view(f"S{width}").ravel()


class _Bucket:
    """Counted entries ``(group, term)`` of one length bucket, merged when they become many."""

    def __init__(self, bucket: int):
        # What an entry counts for: 1 per 16 bytes of its term.
        self.weight = max(1, bucket >> 4)
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, group: np.ndarray, terms: list[np.ndarray], n: np.ndarray,
            docs: np.ndarray) -> None:
        self.parts.append((group, terms, n, docs))
        self.size += self.weight * len(group)

    def merged(self) -> tuple:
        if not self.parts:
            return np.zeros(0, np.uint64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        group = np.concatenate([p[0] for p in self.parts])
        terms = [np.concatenate([p[1][k] for p in self.parts])
                 for k in range(len(self.parts[0][1]))]
        n, docs = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3))
        if len(self.parts) > 1:
            group, terms, n, docs = count_runs(group, terms, n, docs)
            self.parts = [(group, terms, n, docs)]
            self.size = self.weight * len(group)
        return group, terms, n, docs


def count_runs(key: np.ndarray, terms: list[np.ndarray], n: np.ndarray, docs: np.ndarray) -> tuple:
    """Rows sorted by key and term, one per run with its sums."""
    if terms[0].dtype == np.uint64:
        order = radix_order([*terms, key])
    else:
        by_bytes = np.argsort(terms[0], kind="stable")
        order = by_bytes[radix_order([key[by_bytes]])]
    key, n, docs = key[order], n[order], docs[order]
    terms = [t[order] for t in terms]
    first = _starts([key, *terms])
    if not len(first):
        return key, terms, n, docs
    return (key[first], [t[first] for t in terms], np.add.reduceat(n, first),
            np.add.reduceat(docs, first))


def _occurrences(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of a byte string begin, and their lengths."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _IN_TERM[raw]
    change = np.diff(inside)
    begin = np.flatnonzero(change == 1)
    return begin, np.flatnonzero(change == -1) - begin


def _buckets(length: np.ndarray) -> np.ndarray:
    """Bucket of each length: 1 for one word, 2 for two, else the width of the byte rows."""
    wide = 1 << np.ceil(np.log2(np.maximum(length, 17))).astype(np.int64)
    return np.where(length <= 8, 1, np.where(length <= 16, 2, wide))


class TermCounter:
    """Counts of the terms of documents by group, in length buckets."""

    def __init__(self):
        self.buckets: dict[int, _Bucket] = {}

    def _runs(self, raw: np.ndarray, ends: np.ndarray) -> dict[int, tuple]:
        """Per bucket ``(document, term, count)`` of documents laid end to end; document ``d`` ends
        before ``ends[d]``."""
        begin, length = _occurrences(raw)
        doc = np.searchsorted(ends, begin, side="right").astype(np.uint64)
        which = _buckets(length)
        low = _LOWER[raw]
        out = {}
        for b in np.unique(which):
            at = np.flatnonzero(which == b)
            terms = _pack(low, begin[at], length[at], int(b)) if b <= 2 else [
                _byte_rows(low, begin[at], length[at], int(b))]
            one = np.ones(len(at), dtype=np.int64)
            out[int(b)] = count_runs(doc[at], terms, one, one)[:3]
        return out

    def add(self, texts: list[bytes], groups: np.ndarray) -> None:
        """Documents of a few groups, each short."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        for b, (doc, terms, n) in self._runs(raw, ends).items():
            one = np.ones(len(n), dtype=np.int64)
            group = groups[doc.astype(np.int64)].astype(np.uint64)
            self._bucket(b).add(*count_runs(group, terms, n, one))

    def add_long(self, text: bytes, group: int) -> None:
        """One long document, counted piece by piece; pieces end between terms."""
        whole: dict[int, _Bucket] = {}
        raw = np.frombuffer(text, dtype=np.uint8)
        at = 0
        while at < len(raw):
            end = min(at + STEP_BYTES, len(raw))
            while end < len(raw) and _IN_TERM[raw[end]]:
                end += 1
            piece = raw[at:end]
            for b, (doc, terms, n) in self._runs(piece, np.array([len(piece) + 1])).items():
                whole.setdefault(b, _Bucket(b)).add(doc, terms, n, n)
            at = end
        for b, bucket in whole.items():
            doc, terms, n, _ = bucket.merged()
            self._bucket(b).add(np.full(len(n), group, np.uint64), terms, n,
                                np.ones(len(n), dtype=np.int64))

    def _bucket(self, b: int) -> _Bucket:
        return self.buckets.setdefault(b, _Bucket(b))

    def full(self) -> bool:
        """Whether the entries should be handed over, even after merging."""
        if sum(b.size for b in self.buckets.values()) < HELD:
            return False
        for b in self.buckets.values():
            b.merged()
        return 2 * sum(b.size for b in self.buckets.values()) >= HELD

    def take(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """All entries, ``(group, term, count, documents)``, after which the counter is empty."""
        for b, bucket in self.buckets.items():
            group, terms, n, docs = bucket.merged()
            if len(n):
                yield group.astype(np.int64), _as_strings(terms), n, docs
        self.buckets = {}


def _as_strings(terms: list[np.ndarray]) -> pa.Array:
    """Packed terms as an Arrow string column; no term holds a zero byte."""
    if terms[0].dtype == np.uint64:
        rows = np.empty((len(terms[0]), len(terms)), dtype=">u8")
        for k, t in enumerate(terms[::-1]):
            rows[:, k] = t
        rows = rows.view(np.uint8)
    else:
        rows = terms[0].view(np.uint8).reshape(len(terms[0]), -1)
    shown = rows != 0
    ends = np.concatenate(([0], np.cumsum(shown.sum(axis=1)))).astype(np.int32)
    return pa.StringArray.from_buffers(
        len(rows), pa.py_buffer(ends.tobytes()), pa.py_buffer(rows[shown].tobytes()))


def _counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter, names = TermCounter(), {}

    def rows() -> Iterator[pa.RecordBatch]:
        langs = pa.array([k[0] for k in names], pa.string())
        sources = pa.array([k[1] for k in names], pa.string())
        for group, term, n, docs in counter.take():
            at = pa.array(group)
            yield pa.RecordBatch.from_arrays(
                [langs.take(at), sources.take(at), term, pa.array(n), pa.array(docs)],
                ["lang", "source", "term", "n", "docs"])
        names.clear()

    texts: list[bytes] = []
    groups: list[int] = []
    size = 0

    def step() -> None:
        nonlocal texts, groups, size
        if texts:
            counter.add(texts, np.asarray(groups))
        texts, groups, size = [], [], 0

    for batch in stream:
        lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        text = batch.column("text")
        for i in range(batch.num_rows):
            raw = text[i].as_py()
            group = names.setdefault((lang[i], source[i]), len(names))
            if len(raw) > STEP_BYTES:
                counter.add_long(raw, group)
            else:
                texts.append(raw)
                groups.append(group)
                size += len(raw)
            if size >= STEP_BYTES:
                step()
            if not texts and counter.full():
                yield from rows()
    step()
    yield from rows()


def documents_by_group(docs: DataFrame) -> DataFrame:
    """``lang, source, text`` of every row, null as empty, the text as bytes."""
    return docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c)
                         for c in ("lang", "source")],
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, leads`` of all terms in at least ``min_docs`` documents of
    their language; ``leads`` marks one row per (language, term).

    Rows meet once, by (language, term): sums by source and by language need the same partitioning.
    Tasks have added up their own occurrences, so a term arrives at most a few times per task and
    source however often it occurs.
    """
    counted = documents_by_group(docs).mapInArrow(_counted, COUNTS).repartition("lang", "term")
    by_source = counted.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    return by_source.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"),
        F.sum("docs").over(term).alias("lang_docs"),
        (F.min("source").over(term) == F.col("source")).alias("leads"),
    ).filter(F.col("lang_docs") >= min_docs).drop("lang_docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))`` in decimals; null without terms."""
    top = (count.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast(
        "decimal(10,0)")
    both = (total + terms).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", top, F.nullif(both, F.lit(0).cast("decimal(19,0)")))


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; shares are at most 1 + SCALE, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets each (language, source) group apart.

    Part ``pair`` compares the group with every other source of its language over all kept terms;
    part ``term`` lists its most over-represented terms against the whole language. Every row is one
    document, also where ids or texts repeat; null texts, languages and sources count as empty.
    Groups without kept terms have pairs too, with value 0 if the language keeps no term. Other
    columns are ignored, and an empty table gives no rows.
    """
    kept = stored(kept_terms(docs, min_docs), "terms")
    groups = documents_by_group(docs).select("lang", "source").distinct()
    zero = F.lit(0).cast("long")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"),
                                     F.count_if("leads").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", F.coalesce("total", zero).alias("total"),
            F.coalesce("lang_total", zero).alias("lang_total"),
            F.coalesce("terms", zero).alias("terms"),
        ).withColumn("p0", share(zero, F.col("total"), F.col("terms"))), "groups")
    weighed = stored(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "shares")
    over = weighed.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        divergence(F.col("p"), F.col("q")).alias("value"))
    best = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    pairs = _pairs(groups, weighed).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(over).select("lang", "source", "part", "item", "value", "rank")


def _pairs(groups: DataFrame, weighed: DataFrame) -> DataFrame:
    """Divergence of every two sources of a language, over all its kept terms.

    A term that neither source has adds the same number for all such terms. So the sum starts from
    that number times the terms, is corrected for the terms of either source by a histogram of its
    shares, and only the terms that both have are met one by one.
    """
    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    both = a.join(b, "lang").filter(F.col("a") != F.col("b"))
    none = divergence(F.col("a0"), F.col("b0"))
    base = both.select("lang", "a", "b", F.coalesce(none * F.col("terms"), F.lit(0)).alias("x"))
    shares = weighed.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c"))
    of_a = both.join(shares.withColumnRenamed("source", "a"), ["lang", "a"]).select(
        "lang", "a", "b", ((divergence(F.col("p"), F.col("b0")) - none) * F.col("c")).alias("x"))
    of_b = both.join(shares.withColumnRenamed("source", "b"), ["lang", "b"]).select(
        "lang", "a", "b", ((divergence(F.col("a0"), F.col("p")) - none) * F.col("c")).alias("x"))
    left = weighed.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"),
                          F.col("p0").alias("a0"))
    right = weighed.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"),
                           F.col("p0").alias("b0"))
    met = left.join(right, ["lang", "term"]).filter(F.col("a") != F.col("b"))
    shared = met.select("lang", "a", "b", (
        divergence(F.col("pa"), F.col("pb")) - divergence(F.col("pa"), F.col("b0"))
        - divergence(F.col("a0"), F.col("pb")) + none).alias("x"))
    added = base.unionByName(of_a).unionByName(of_b).unionByName(
        shared.groupBy("lang", "a", "b").agg(F.sum("x").alias("x")))
    return added.groupBy("lang", "a", "b").agg(F.sum("x").alias("value")).select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"),
        "value")
