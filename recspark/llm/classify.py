"""What both text classifiers share: a bounded, balanced sample of labelled rows, and scoring.

Labels are learned from at most ``PER_CLASS`` documents of each class, those with the smallest
digests of their text, among labelled rows outside the held-out fold that have at most
``SAMPLE_CHARS`` characters. Everything else reads whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import held_out, slices, stored

PER_CLASS = 2_000
SAMPLE_CHARS = 20_000


def learnable(labels: DataFrame, target: str) -> DataFrame:
    """``doc_id, label`` outside the held-out fold; an id that repeats counts once (largest label)."""
    return labels.select(F.col("doc_id"), F.col(f"`{target}`").cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(
        F.max("label").alias("label"))


def text_key() -> Column:
    """The digest that distinct texts are told apart and ordered by."""
    return F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("|sample")))


def distinct_texts(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """``key, label, doc_id, chars`` of every distinct text that can be learned from, stored: the row
    with the smallest id stands for its copies, a text under both labels is in both classes."""
    chars = F.length(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", text_key().alias("key"), chars.cast("long").alias("chars"))
    return stored(keyed.join(learnable(labels, target), "doc_id").groupBy("key", "label").agg(
        F.min("doc_id").alias("doc_id"), F.max("chars").alias("chars")), "texts")


def training_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int = PER_CLASS,
                    sample_chars: int = SAMPLE_CHARS, lang: bool = False):
    """``text, label[, lang]`` of the sample and the share of label 1 among all learnable rows.

    Rows of ``labels`` that repeat an id count once (largest label); rows without id, label or
    document are not learned from. A text that appears under both labels is left to both classes.
    Ids and digests are joined and ordered, texts are read for the chosen ids only.
    """
    known = learnable(labels, target)
    share = known.agg(F.avg("label").alias("p")).first()["p"]
    text = F.coalesce("text", F.lit(""))
    key = text_key()
    fits = docs.filter(F.length(text) <= sample_chars)
    keyed = fits.select("doc_id", key.alias("key")).join(known, "doc_id")
    chosen = {}
    for y in (0, 1):
        # The head of the class: a bounded take, not an order over all rows.
        head = keyed.filter(F.col("label") == y).groupBy("key").agg(
            F.min("doc_id").alias("doc_id")).orderBy("key").limit(per_class)
        chosen |= {(r["key"], y): r["doc_id"] for r in head.collect()}
    cols = ["doc_id", text.alias("text"), key.alias("key"), *(["lang"] if lang else [])]
    rows = fits.filter(F.col("doc_id").isin(sorted(set(chosen.values())))).select(
        *cols).dropDuplicates(["doc_id", "key"]).toPandas()
    at = {(k, i): n for n, (k, i) in enumerate(zip(rows["key"], rows["doc_id"], strict=True))}
    order = sorted(chosen)
    sample = rows.iloc[[at[k, chosen[k, y]] for k, y in order]].assign(label=[y for _, y in order])
    share = float(share) if share is not None else 0.0
    return sample[["text", "label", *(["lang"] if lang else [])]], share


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def log_odds(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def fit_offset(z: np.ndarray, y: np.ndarray, steps: int = 100,
               counts: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve over raw scores (Newton steps, slightly damped); a score
    may stand for several, ``counts`` of them."""
    z = np.asarray(z, dtype=np.float64)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        w = (p * (1 - p) + 1e-9) * counts
        miss = (p - y) * counts
        g = np.array([np.sum(miss * z) + 1e-2 * (a - 1), np.sum(miss) + 1e-2 * b])
        h = np.array([[np.sum(w * z * z) + 1e-2, np.sum(w * z)],
                      [np.sum(w * z), np.sum(w) + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def scored(docs: DataFrame, scores_of: Callable[[list], np.ndarray], column: str = "score",
           text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of its text; ``scores_of`` runs on the executors.

    An input column named like the score is replaced.
    """
    kept = docs.drop(column)
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])
    at = kept.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream):
            found = scores_of(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, column])

    return kept.mapInArrow(run, schema)
