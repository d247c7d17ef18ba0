"""Review text profiles of users and items: TF-IDF vectors and cosine scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scores import clip_unit, cosine
from ..functions.text import review_snippet, with_bigrams, word_tokens
from ..skew import MAX_BROADCAST_ROWS, dealt, durable, global_position, oversized_keys
from .stats import with_scalars
from .topk import top_k

MIN_DOCUMENTS = 10
MIN_ITEM_TEXT = 30
MIN_USER_TEXT = 20
SIM_DIGITS = 9
# Pool rows of a block, which meets its vectors in one task.
BLOCK_ROWS = 8192


def snippets(reviews: DataFrame, max_body_len: int = 400) -> DataFrame:
    """Reviews with a non-empty ``snippet``.

    The empty ones are dropped by a generator: a filter would be pushed below the projection and
    build every snippet a second time.
    """
    text = F.array(review_snippet(max_body_len=max_body_len))
    return reviews.withColumn("snippet", F.explode(F.filter(text, lambda t: t != "")))


def merged_text(snips: DataFrame, key: str, order: str, max_parts: int) -> DataFrame:
    """The first ``max_parts`` snippets of each key in ingest order, joined by blanks."""
    first = top_k(snips.select(key, order, "snippet"), key, [F.col(order), F.col("snippet")],
                  max_parts, "_rn")
    parts = F.array_sort(F.collect_list(F.struct("_rn", "snippet")))
    return first.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["snippet"]), " ").alias("doc")
    )


def _snippets_of(reviews: DataFrame, max_body_len: int) -> DataFrame:
    """Reviews that have snippets already are taken as they are."""
    return reviews if "snippet" in reviews.columns else snippets(reviews, max_body_len)


def item_documents(reviews: DataFrame, order: str = "row_key", max_parts: int = 12,
                   max_body_len: int = 400) -> DataFrame:
    docs = merged_text(_snippets_of(reviews, max_body_len), "item_id", order, max_parts)
    return docs.filter(F.length("doc") >= MIN_ITEM_TEXT)


def user_documents(reviews: DataFrame, order: str = "row_key", max_parts: int = 15,
                   max_body_len: int = 400) -> DataFrame:
    """Profile text per user; too short a text carries no similarity and is left out."""
    docs = merged_text(_snippets_of(reviews, max_body_len), "user_id", order, max_parts)
    return docs.filter(F.length("doc") >= MIN_USER_TEXT)


def term_counts(docs: DataFrame, key: str, stop_words: list[str], bigrams: bool = True) -> DataFrame:
    """Occurrences of each term per document.

    Words and terms leave generators of one row: Spark drops empty arrays ahead of a generator, by a
    filter that would be pushed below the projection and tokenise every text several times.
    """
    terms = docs.select(key, F.explode(F.array(word_tokens("doc", stop_words))).alias("words"))
    if bigrams:
        terms = terms.select(key, F.explode(F.array(with_bigrams("words"))).alias("words"))
    return (
        terms.select(key, F.explode("words").alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(counts: DataFrame, n_docs: DataFrame, min_df: int = 2,
               max_features: int = 4000) -> DataFrame:
    """Document frequency, corpus frequency and inverse document frequency of the kept terms.

    Kept are the ``max_features`` most frequent terms found in at least ``min_df`` documents, ties
    in term order. ``n_docs`` is one row with the number of documents.
    """
    stats = counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf")
    )
    kept = (
        stats.filter(F.col("df") >= min_df)
        .orderBy(F.col("corpus_tf").desc(), F.col("term"))
        .limit(max_features)
    )
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return with_scalars(kept, n_docs).withColumn("idf", idf).drop("n_docs")


def tfidf(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Length-normalised term weights per document."""
    raw = counts.join(vocab.select("term", "idf"), "term").select(
        key, "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def _small(df: DataFrame, n_rows: int) -> DataFrame:
    """A table of at most ``n_rows`` rows, sent to every executor if they are few."""
    return F.broadcast(df) if n_rows <= MAX_BROADCAST_ROWS else df


def _products(n_terms: int):
    """Inner products of the pool rows of a block, from the vectors of its users and items."""
    def run(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        lists = vectors.column("t").combine_chunks()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        first = np.concatenate(([0], np.cumsum(size)))
        term = lists.flatten().to_numpy(zero_copy_only=False)
        weight = vectors.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        places = {c: {x: k for k, x in enumerate(vectors.column(c).to_pylist()) if x is not None}
                  for c in ("user_id", "item_id")}
        known: dict[int, list[tuple[int, int]]] = {}
        for n, (user, item) in enumerate(zip(rows.column("user_id").to_pylist(),
                                             rows.column("item_id").to_pylist(), strict=True)):
            u, i = places["user_id"].get(user), places["item_id"].get(item)
            if u is not None and i is not None:
                known.setdefault(u, []).append((n, i))
        out, dense = np.zeros(rows.num_rows), np.zeros(n_terms)
        for u, found in known.items():
            own = slice(first[u], first[u + 1])
            np.add.at(dense, term[own], weight[own])
            at, items = np.array(found).T
            count = size[items]
            pick = np.arange(count.sum()) + np.repeat(
                first[items] - np.cumsum(count) + count, count)
            out[at] = np.bincount(np.repeat(np.arange(len(at)), count),
                                  dense[term[pick]] * weight[pick], len(at))
            dense[term[own]] = 0
        return pa.table({"user_id": rows.column("user_id"), "item_id": rows.column("item_id"),
                         "s": pa.array(out)})

    return run


@dataclass
class TextProfiles:
    """TF-IDF vectors of items and users over a vocabulary learned from item documents."""

    item_weights: DataFrame
    user_weights: DataFrame
    vocab: DataFrame

    @classmethod
    def fit(
        cls,
        reviews: DataFrame,
        max_features: int = 4000,
        min_df: int = 2,
        max_parts_per_item: int = 12,
        max_reviews_per_user: int = 15,
        stop_words: list[str] | None = None,
        bigrams: bool = True,
        order: str = "row_key",
    ) -> "TextProfiles":
        """``stop_words`` defaults to Spark's English list."""
        if stop_words is None:
            stop_words = StopWordsRemover.loadDefaultStopWords("english")
        # Both kinds of documents are made of the same snippets: texts are read once.
        reviews = durable(snippets(reviews).select(
            *dict.fromkeys(("user_id", "item_id", order, "snippet"))))
        items = durable(item_documents(reviews, order, max_parts_per_item))
        if len(items.take(MIN_DOCUMENTS)) < MIN_DOCUMENTS:
            raise ValueError(f"a text index needs at least {MIN_DOCUMENTS} items with text")
        users = user_documents(reviews, order, max_reviews_per_user)
        # Read twice: for the vocabulary and for the weights.
        item_counts = durable(term_counts(items, "item_id", stop_words, bigrams))
        user_counts = term_counts(users, "user_id", stop_words, bigrams)
        n_docs = items.agg(F.count(F.lit(1)).alias("n_docs"))
        vocab = durable(vocabulary(item_counts, n_docs, min_df, max_features))
        # The counts ask for merge joins; a short vocabulary comes to them instead.
        kept = _small(vocab, max_features)
        return cls(
            durable(tfidf(item_counts, kept, "item_id")),
            durable(tfidf(user_counts, kept, "user_id")),
            vocab,
        )

    def score(self, pool: DataFrame) -> DataFrame:
        """Cosine of user profile and item document for each (user, item) of the pool, 0 if unknown.

        Pairs outside the pool are never formed. Pool rows are dealt to blocks by user; a block gets
        the vector of each of its users and items once, and its products are summed there.
        """
        pool = durable(pool.select("user_id", "item_id").distinct())
        n_blocks = max(-(-pool.count() // BLOCK_ROWS), 1)
        terms = global_position(self.item_weights.select("term").distinct(), [F.col("term")], "t", 0)
        n_terms = terms.count()
        terms = _small(terms, n_terms)
        # A user with more rows than a block holds is in several, one without id in any.
        big = oversized_keys(pool, "user_id", BLOCK_ROWS)
        shares = F.when(F.col("user_id").isNull(), F.lit(n_blocks)).otherwise(
            F.coalesce(F.ceil(F.col("group_rows") / BLOCK_ROWS), F.lit(1)))
        share = F.pmod(F.xxhash64("item_id"), shares)
        rows = pool.join(big.filter("user_id is not null"), "user_id", "left").select(
            F.pmod(F.xxhash64("user_id", share), F.lit(n_blocks)).alias("block"), "user_id", "item_id")

        def vectors(weights: DataFrame, key: str) -> DataFrame:
            entry = F.struct("t", "weight")
            packed = weights.join(terms, "term").groupBy(key).agg(
                F.array_sort(F.collect_list(entry)).alias("v"))
            # Columns of their own: the rows are on the other side of the blocks too.
            return rows.select("block", key).distinct().join(packed, key).select(
                F.col("block").alias("block"), F.col(key).alias(key), F.col("v.t").alias("t"),
                F.col("v.weight").alias("w"))

        both = vectors(self.user_weights, "user_id").unionByName(
            vectors(self.item_weights, "item_id"), allowMissingColumns=True)
        ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields)
        sims = dealt(rows, "block").groupBy("block").cogroup(dealt(both, "block").groupBy("block")) \
            .applyInArrow(_products(n_terms), f"{ids}, s double")
        return sims.select(
            "user_id", "item_id", F.round(clip_unit("s"), SIM_DIGITS).alias("text_sim"))


@dataclass
class DenseProfiles:
    """Ready embeddings of users and items (``id``, ``embedding``)."""

    users: DataFrame
    items: DataFrame

    @classmethod
    def fit(cls, reviews: DataFrame, encoder, order: str = "row_key",
            max_parts_per_item: int = 12, max_reviews_per_user: int = 15) -> "DenseProfiles":
        """Encode profile texts. ``encoder`` maps a text column to an array column (a pandas UDF)."""
        items = item_documents(reviews, order, max_parts_per_item)
        if len(items.take(MIN_DOCUMENTS)) < MIN_DOCUMENTS:
            raise ValueError(f"a text index needs at least {MIN_DOCUMENTS} items with text")
        users = user_documents(reviews, order, max_reviews_per_user, max_body_len=500)
        encode: Column = encoder
        return cls(
            users.select(F.col("user_id").alias("id"), encode("doc").alias("embedding")),
            items.select(F.col("item_id").alias("id"), encode("doc").alias("embedding")),
        )

    def score(self, pool: DataFrame) -> DataFrame:
        pool = pool.select("user_id", "item_id").distinct()
        u = self.users.select(F.col("id").alias("user_id"), F.col("embedding").alias("_u"))
        i = self.items.select(F.col("id").alias("item_id"), F.col("embedding").alias("_i"))
        joined = pool.join(u, "user_id", "left").join(i, "item_id", "left")
        return joined.select(
            "user_id",
            "item_id",
            F.coalesce(cosine("_u", "_i"), F.lit(0.0)).alias("text_sim"),
        )
