"""Quality by supervised subword embeddings: the average of learned vectors of hashed words and
character n-grams, and a softmax over it, trained by stochastic gradient descent in NumPy.

With a linear output, the margin of a document is the average of one number per feature (its vector
times the output's), so scoring gathers a single float per word and n-gram.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .classify import PER_CLASS, SAMPLE_CHARS, fit_offset, log_odds, scored, sigmoid, \
    training_sample
from .common import held_out
from .words import Words, batches

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.5
SEED = 7


def _features(texts: list[bytes]):
    """Yield ``(bucket per feature, text per feature or its borders)`` for words and n-grams."""
    w = Words(texts, lower=False)
    yield (w.hashes() >> np.uint64(48)).astype(np.int64), w.first
    begin, end = w.text_start, w.text_end
    for n in GRAMS:
        h = ((w.gram_hashes(n) + np.uint64(n)) >> np.uint64(48)).astype(np.int64)
        # The space after each text takes part, so a text has as many n-grams as bytes fit.
        last = np.minimum(np.maximum(end + 2 - n, begin), len(h))
        yield h, np.stack((np.minimum(begin, len(h)), last))


def _borders(borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (borders[:-1], borders[1:]) if borders.ndim == 1 else (borders[0], borders[1])


class QualityModel:
    """``margin(texts)`` is the averaged margin of every text, ``score`` its probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias = weights, bias
        self.slope, self.offset = slope, offset

    def margin(self, texts: list) -> np.ndarray:
        out = []
        for part in batches(texts):
            total = np.zeros(len(part))
            count = np.zeros(len(part))
            for h, borders in _features(part):
                first, last = _borders(borders)
                sums = np.concatenate(([0.0], np.cumsum(self.weights[h], dtype=np.float64)))
                total += sums[last] - sums[first]
                count += last - first
            out.append(total / np.maximum(count, 1) + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list) -> np.ndarray:
        return sigmoid(self.slope * self.margin(texts) + self.offset)


def train(texts: list[str], labels: np.ndarray, base_rate: float | None = None,
          seed: int = SEED) -> QualityModel:
    """Fit on texts with labels 0 and 1; without both classes every score is the base rate.

    Every fifth text is kept from training and calibrates the probability, shifted to the share of
    label 1 among all labelled rows if that is given.
    """
    y = np.asarray(labels, dtype=np.float64)
    rate = float(y.mean()) if len(y) and base_rate is None else (base_rate or 0.0)
    if len(y) < 10 or y.min() == y.max():
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0, 1.0, log_odds(rate))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    texts, y = [texts[i] for i in order], y[order]
    bags = []  # per text: distinct buckets and their shares
    for part in batches(texts):
        split = [(h, *_borders(b)) for h, b in _features(part)]
        for i in range(len(part)):
            ids, n = np.unique(np.concatenate([h[f[i]:l[i]] for h, f, l in split]),
                               return_counts=True)
            bags.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    vectors = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    output = np.zeros((DIMENSIONS, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    learn = [i for i in range(len(bags)) if i % 5]
    for epoch in range(EPOCHS):
        for step, i in enumerate(rng.permutation(learn)):
            pace = RATE * (1 - (epoch * len(learn) + step) / (EPOCHS * len(learn)))
            ids, share = bags[i]
            mean = share @ vectors[ids]
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            # The average spreads a gradient over many rows; each row moves by the whole of it.
            vectors[ids] -= pace * np.outer(share / share.max(initial=1e-9), output @ p)
            output -= pace * np.outer(mean, p)
            bias -= pace * p
    margin = output[:, 1] - output[:, 0]
    model = QualityModel((vectors @ margin).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    check = [i for i in range(len(texts)) if i % 5 == 0]
    z = model.margin([texts[i] for i in check])
    model.slope, model.offset = fit_offset(z, y[check])
    model.offset += log_odds(rate) - log_odds(float(y.mean()))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
        sample_chars: int = SAMPLE_CHARS) -> QualityModel:
    rows, rate = training_sample(docs, labels, "quality", per_class, sample_chars)
    return train(rows["text"].tolist(), rows["label"].to_numpy(), rate)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``. Null texts score as empty ones."""
    return scored(docs, model.score).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Learned from ``labels`` outside the held-out fold. A row without an id counts as held out.
    Repeated rows score alike, other columns are ignored, no rows give no rows; without labels of
    both classes every score is their share.
    """
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model, threshold).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns."""
    model = fit(docs, labels)
    return scored(docs, model.score, "_quality").filter(
        F.col("_quality") >= threshold).select(*docs.columns)
