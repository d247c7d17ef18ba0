"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths and
max pooling over the whole text, trained in NumPy, with decision thresholds calibrated by language.

A balanced sample starts the model. Where there are more texts, tasks train copies of it, each on its
part of all of them, the copies are averaged, and all texts kept from training calibrate the mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .classify import PER_CLASS, SAMPLE_CHARS, distinct_texts, fit_offset, log_odds, scored, \
    sigmoid, text_key, training_sample
from .common import held_out, slices
from .words import Words, batches, mixed

BUCKETS = 1 << 16
DIMENSIONS = 12
# First bytes of a word that count as its stem.
HEADS = (4, 6)
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH = 32
RATE = 0.01
SEED = 11
# Words that a step may hold, characters that a task trains on, tasks, and a calibrated unit of margin.
STEP_WORDS = 1 << 16
TASK_CHARS, MAX_TASKS = 16_000_000, 256
BINS, WIDEST = 64, 64
# Parts of a unit that changes are added up in, as whole numbers: the order of a sum is no matter.
PARTS = float(1 << 24)


def _word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words (letters in any ASCII case) and the first word of each text.

    A word has one bucket of its own and one for each of its beginnings, so that unseen forms of a
    known stem are recognised; its embedding is the sum of all.
    """
    w = Words(texts)
    ids = [(mixed(h + np.uint64(k)) >> np.uint64(48)).astype(np.int64)
           for k, h in enumerate(w.hashes(*HEADS))]
    return np.stack(ids), w.first


class ToxicityModel:
    """``embed`` (buckets x dimensions), per width ``filters`` (width*dimensions x filters) with
    biases, and a logistic output over all pooled features."""

    def __init__(self, embed, filters, biases, output, bias):
        self.embed, self.filters, self.biases = embed, filters, biases
        self.output, self.bias = output, bias
        self.slope, self.offset = 1.0, 0.0
        self.by_lang: dict[str, float] = {}
        self.default = 0.5

    def pooled(self, ids: np.ndarray, first: np.ndarray, argmax: bool = False):
        """Max over each text's windows of every filter, and where it was reached.

        The words of a text are followed by as many zero vectors as the widest filter needs; a text
        with fewer words than a filter has one window that reaches into them.
        """
        counts = np.diff(first)
        pad = max(WIDTHS)
        place = np.arange(int(counts.sum())) + pad * np.repeat(np.arange(len(counts)), counts)
        rows = np.zeros((len(place) + pad * len(counts) + 2 * pad + 1, DIMENSIONS), np.float32)
        rows[place] = sum(self.embed[i] for i in ids)
        begin = first[:-1] + pad * np.arange(len(counts))
        # All filters' products in one go, words along the last axis; windows are shifted sums.
        taps = np.concatenate([f.reshape(-1, DIMENSIONS, FILTERS).transpose(0, 2, 1).reshape(
            -1, DIMENSIONS) for f in self.filters])
        products = taps @ rows.T
        m, tap = len(rows) - pad, 0
        features, where = [], []
        for k, width in enumerate(WIDTHS):
            act = products[tap:tap + FILTERS, :m].copy()
            for j in range(1, width):
                act += products[tap + j * FILTERS:tap + (j + 1) * FILTERS, j:m + j]
            tap += width * FILTERS
            stop = begin + np.maximum(counts - width + 1, 1)
            if not len(counts):
                top = act[:, :0]
            else:
                top = np.maximum.reduceat(
                    act, np.stack((begin, stop), axis=1).ravel(), axis=1)[:, ::2]
            if argmax:
                where.append(np.stack([a + np.argmax(act[:, a:b], axis=1)
                                       for a, b in zip(begin, stop, strict=True)]))
            features.append(np.maximum(top + self.biases[k][:, None], 0))
        return np.concatenate(features).T, where, rows, place

    def margin(self, texts: list) -> np.ndarray:
        out = []
        for part in batches(texts):
            ids, first = _word_ids(part)
            pooled = self.pooled(ids, first)[0]
            out.append(pooled.astype(np.float64) @ self.output + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list) -> np.ndarray:
        return sigmoid(self.slope * self.margin(texts) + self.offset)


def _steps(n: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    order = rng.permutation(n)
    for k in range(0, n, BATCH):
        yield order[k:k + BATCH]


class Trainer:
    """A model in training with the state of its steps: AdaGrad for the embedding, Adam for the rest."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.dense()]
        self.squares = np.zeros(BUCKETS, dtype=np.float32)  # per-row AdaGrad for the sparse embedding
        self.touched = np.zeros(BUCKETS, dtype=np.int64)  # steps that moved a row
        self.bias_m = [0.0, 0.0]
        self.t = 0

    def dense(self) -> list[np.ndarray]:
        return [*self.model.filters, *self.model.biases, self.model.output]

    def step(self, words: list[np.ndarray], y: np.ndarray) -> None:
        """One step over texts, given as the buckets of their words."""
        model = self.model
        self.t += 1
        t = self.t
        ids = np.concatenate(words, axis=1)
        first = np.concatenate(([0], np.cumsum([w.shape[1] for w in words])))
        pooled, where, rows, place = model.pooled(ids, first, argmax=True)
        p = sigmoid(pooled @ model.output + model.bias)
        d = (p - y) / len(words)
        grads_out = pooled.T @ d + 1e-4 * model.output
        back = np.outer(d, model.output) * (pooled > 0)
        grad_f, grad_b = [], []
        at_all, g_all = [], []
        for k, width in enumerate(WIDTHS):
            g = back[:, k * FILTERS:(k + 1) * FILTERS]
            at = where[k]
            f = model.filters[k].reshape(width, DIMENSIONS, FILTERS)
            gf = np.zeros_like(f)
            for j in range(width):
                src = rows[at + j]                       # texts x filters x dimensions
                gf[j] = np.einsum("tfd,tf->df", src, g)
                at_all.append((at + j).ravel())
                g_all.append((g[:, :, None] * f[j].T[None]).reshape(-1, DIMENSIONS))
            grad_f.append(gf.reshape(width * DIMENSIONS, FILTERS))
            grad_b.append(g.sum(axis=0))
        row_at, row_g = np.concatenate(at_all), np.concatenate(g_all).astype(np.float32)
        word_of = np.full(len(rows), -1)
        word_of[place] = np.arange(len(place))
        inside = word_of[row_at] >= 0
        row_g, row_at = row_g[inside], row_at[inside]
        bucket = ids[:, word_of[row_at]].ravel()
        row_g = np.tile(row_g, (len(ids), 1))
        used, inverse = np.unique(bucket, return_inverse=True)
        total = np.zeros((len(used), DIMENSIONS), dtype=np.float32)
        np.add.at(total, inverse, row_g)
        self.touched[used] += 1
        self.squares[used] += (total ** 2).mean(axis=1)
        model.embed[used] -= 5 * RATE * total / (np.sqrt(self.squares[used])[:, None] + 1e-6)
        fix1, fix2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        for q, g, m in zip(self.dense(), [*grad_f, *grad_b, grads_out], self.moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.001 * (g * g - m[1])
            q -= RATE * (m[0] / fix1) / (np.sqrt(m[1] / fix2) + 1e-8)
        gb, bias_m = float(d.sum()), self.bias_m
        bias_m[0] += 0.1 * (gb - bias_m[0])
        bias_m[1] += 0.001 * (gb * gb - bias_m[1])
        model.bias -= RATE * (bias_m[0] / fix1) / (np.sqrt(bias_m[1] / fix2) + 1e-8)


def _word_lists(texts: list) -> Iterator[np.ndarray]:
    for part in batches(texts):
        ids, first = _word_ids(part)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield ids[:, a:b]


def train(texts: list[str], labels: np.ndarray, langs: list | None = None,
          base_rate: float | None = None, seed: int = SEED) -> ToxicityModel:
    """Fit with Adam steps on texts with labels 0 and 1 and calibrate on every fifth text.

    Without both classes every score is the base rate.
    """
    return _trained(texts, labels, langs, base_rate, seed).model


def _trained(texts: list[str], labels: np.ndarray, langs: list | None = None,
             base_rate: float | None = None, seed: int = SEED) -> Trainer:
    y = np.asarray(labels, dtype=np.float64)
    rng = np.random.default_rng(seed)
    size = len(WIDTHS) * FILTERS
    model = ToxicityModel(
        (rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))).astype(np.float32),
        [rng.normal(0, 0.3, (w * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, size), 0.0)
    trainer = Trainer(model)
    rate = float(y.mean()) if len(y) and base_rate is None else (base_rate or 0.0)
    if len(y) < 10 or y.min() == y.max():
        model.output[:] = 0
        model.offset = log_odds(rate)
        return trainer
    order = rng.permutation(len(texts))
    texts, y = [texts[i] for i in order], y[order]
    langs = [langs[i] for i in order] if langs is not None else None
    words = list(_word_lists(texts))
    learn = np.array([i for i in range(len(texts)) if i % 5])
    for _ in range(EPOCHS):
        for rows_of in _steps(len(learn), rng):
            chosen = learn[rows_of]
            trainer.step([words[i] for i in chosen], y[chosen])
    check = np.array([i for i in range(len(texts)) if i % 5 == 0])
    z = model.margin([texts[i] for i in check])
    have = np.array([langs[i] or "" for i in check]) if langs is not None else None
    _calibrate(model, z, y[check], np.ones(len(check)), have, rate, float(y.mean()))
    return trainer


def _calibrate(model: ToxicityModel, z: np.ndarray, y: np.ndarray, counts: np.ndarray,
               langs: np.ndarray | None, rate: float, mean: float) -> None:
    """Slope, offset and thresholds from margins ``z``, each of ``counts`` texts; ``mean`` is the share
    of label 1 among what was learned from, ``rate`` the share among all labelled rows."""
    model.slope, model.offset = fit_offset(z, y, counts=counts)
    model.offset += log_odds(rate) - log_odds(mean)
    weight = np.where(y == 1, rate / mean, (1 - rate) / (1 - mean)) * counts
    p = sigmoid(model.slope * z + model.offset)
    model.default = best_threshold(p, y, weight)
    if langs is not None:
        for lang in np.unique(langs):
            inside = langs == lang
            n, ones = counts[inside].sum(), (counts * y)[inside].sum()
            if ones >= 10 and n - ones >= 10:
                model.by_lang[str(lang)] = best_threshold(p[inside], y[inside], weight[inside])


def _kept_back(key: str | Column) -> Column:
    """Every fifth text, by its digest, calibrates."""
    return F.crc32(key) % 5 == 0


def _sums(trainer: Trainer, before: Trainer, rows: int) -> pa.RecordBatch:
    """What a task's training changed, times its weight: a row for every row of the embedding that
    moved, weighted by the steps that moved it, and below 0 all other numbers, weighted by texts."""
    moved = np.flatnonzero(trainer.touched)
    w = trainer.touched[moved]
    change = np.column_stack([trainer.model.embed[moved] - before.model.embed[moved],
                              trainer.squares[moved] - before.squares[moved]]).astype(np.float64)
    now, old = _numbers(trainer), _numbers(before)
    flat = np.zeros(-(-len(now) // (DIMENSIONS + 1)) * (DIMENSIONS + 1))
    flat[:len(now)] = now - old
    rest = flat.reshape(-1, DIMENSIONS + 1)
    parts = np.rint(np.concatenate((rest * rows, change * w[:, None])) * PARTS).astype(np.int64)
    place = np.concatenate((-1 - np.arange(len(rest)), moved))
    weight = np.concatenate((np.full(len(rest), rows), w))
    return pa.RecordBatch.from_arrays(
        [pa.array(place), pa.array(weight), *[pa.array(c) for c in parts.T.copy()]],
        ["place", "weight", *[f"c{k}" for k in range(DIMENSIONS + 1)]])


def _numbers(trainer: Trainer) -> np.ndarray:
    """All parameters but the embedding, with their moments."""
    return np.concatenate([
        *[np.ravel(p) for p in trainer.dense()], *[np.ravel(m) for pair in trainer.moments for m in pair],
        [trainer.model.bias, *trainer.bias_m]]).astype(np.float64)


def _set_numbers(trainer: Trainer, flat: np.ndarray) -> None:
    at = 0
    for p in [*trainer.dense(), *[m for pair in trainer.moments for m in pair]]:
        p[...] = flat[at:at + p.size].reshape(p.shape)
        at += p.size
    trainer.model.bias, trainer.bias_m = float(flat[at]), [float(x) for x in flat[at + 1:at + 3]]


def _train_on_all(trainer: Trainer, docs: DataFrame, texts: DataFrame) -> None:
    """Train on every text that is not kept back: copies of the model, each over the texts of a task in
    the order of their digests; then the mean of the copies that moved a number, by how often.

    The number of tasks follows from the characters, so the result does not depend on the cluster.
    """
    chars = texts.agg(F.sum("chars")).first()[0]
    tasks = int(min(max(1, -(-chars // TASK_CHARS)), MAX_TASKS))
    mine = docs.select("doc_id", text_key().alias("key"), "text").filter(
        ~held_out("doc_id") & ~_kept_back("key"))
    rows = mine.repartition(tasks, "key", "doc_id").join(
        texts.select("key", "doc_id", "label").repartition(tasks, "key", "doc_id").hint("merge"),
        ["key", "doc_id"]).select("text", "label")
    state = docs.sparkSession.sparkContext.broadcast(trainer)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copy import deepcopy

        own, n = deepcopy(state.value), 0
        own.touched[:] = 0
        words, y = [], []
        for batch in slices(stream):
            for w, label in zip(_word_lists(batch.column("text").to_pylist()),
                                batch.column("label").to_pylist(), strict=True):
                if words and (len(words) == BATCH or w.shape[1] + sum(
                        x.shape[1] for x in words) > STEP_WORDS):
                    own.step(words, np.array(y, dtype=np.float64))
                    words, y = [], []
                words.append(w)
                y.append(label)
                n += 1
        if words:
            own.step(words, np.array(y, dtype=np.float64))
        if n:
            yield _sums(own, state.value, n)

    names = [f"c{k}" for k in range(DIMENSIONS + 1)]
    kinds = T.StructType([T.StructField(c, T.LongType()) for c in ("place", "weight", *names)])
    # As many rows as the model has, whatever the number of texts.
    found = rows.mapInArrow(run, kinds).groupBy("place").agg(
        *[F.sum(c).alias(c) for c in ("weight", *names)]).toPandas().sort_values("place")
    state.unpersist()
    change = found[names].to_numpy() / PARTS / found["weight"].to_numpy()[:, None]
    inside = found["place"].to_numpy() >= 0
    at = found["place"].to_numpy()[inside]
    trainer.model.embed[at] += change[inside][:, :DIMENSIONS].astype(np.float32)
    trainer.squares[at] += change[inside][:, DIMENSIONS].astype(np.float32)
    numbers = _numbers(trainer)
    _set_numbers(trainer, numbers + change[~inside][::-1].ravel()[:len(numbers)])


def _calibrate_on_all(model: ToxicityModel, docs: DataFrame, texts: DataFrame, rate: float) -> None:
    """Calibrate on every text that was kept back: margins, to a 64th, are counted by label and
    language."""
    mine = docs.select("doc_id", text_key().alias("key"), "text", "lang").filter(
        ~held_out("doc_id") & _kept_back("key"))
    found = scored(mine, model.margin, "z").select(
        "doc_id", "key", F.coalesce("lang", F.lit("")).alias("lang"),
        F.rint(F.greatest(F.least("z", F.lit(float(WIDEST))), F.lit(-float(WIDEST))) * BINS)
        .cast("long").alias("bin"))
    bins = found.join(texts.select("key", "doc_id", "label"), ["key", "doc_id"]).groupBy(
        "lang", "bin", "label").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(
        ["lang", "bin", "label"])
    n, y = bins["n"].to_numpy(dtype=np.float64), bins["label"].to_numpy(dtype=np.float64)
    if not 0 < (n * y).sum() < n.sum():
        return  # one class alone: what the sample gave stays
    mean = float((n * y).sum() / n.sum())
    model.by_lang = {}
    _calibrate(model, bins["bin"].to_numpy() / BINS, y, n, bins["lang"].to_numpy(dtype=str), rate, mean)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score from which calling a text toxic gives the best F1 on weighted examples."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(weight[order] * y[order])
    called = np.cumsum(weight[order])
    f1 = 2 * hit / np.maximum(called + (weight * y).sum(), 1e-12)
    k = int(np.argmax(f1))
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + after) / 2)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
        sample_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """A model of all labelled texts outside the held-out fold, started from a sample of them."""
    rows, rate = training_sample(docs, labels, "toxic", per_class, sample_chars, lang=True)
    y = rows["label"].to_numpy()
    trainer = _trained(rows["text"].tolist(), y, rows["lang"].tolist(), rate)
    texts = distinct_texts(docs, labels, "toxic")
    if len(y) >= 10 and y.min() < y.max() and texts.count() > len(y):
        # From equal classes to the shares they have.
        trainer.model.bias += log_odds(rate) - log_odds(float(y.mean()))
        _train_on_all(trainer, docs, texts)
        _calibrate_on_all(trainer.model, docs, texts, rate)
    return trainer.model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (score from 0.5) and, by the threshold of the row's
    language, ``threshold`` and ``flagged``. The score itself never sees the language."""
    threshold = F.lit(model.default)
    for lang, value in sorted(model.by_lang.items()):
        threshold = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(threshold)
    return scored(docs, model.score).withColumns({
        "predicted": (F.col("score") >= 0.5).cast("int"),
        "threshold": threshold,
    }).withColumn("flagged", (F.col("score") >= F.col("threshold")).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, flagged``, one row per row of ``docs``.

    Null texts score as empty ones; a row without an id counts as held out; repeated rows score
    alike; other columns are ignored; no rows give no rows. Without labels of both classes every
    score is their share.
    """
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "threshold",
        "flagged")
