import random
import zlib

import numpy as np
import pytest
from helpers import awkward, clashing, frame

from recspark.llm import quality, toxicity
from recspark.llm.classify import fit_offset, sigmoid

WORDS = [a + b for a in ("th", "er", "on", "an", "re") for b in ("ing", "ed", "es", "ly", "tion")]
BAD = ["gromp", "snarv", "blixo"]


def corpus(n, seed=0):
    """Texts of made-up words; toxic ones hold a bad word, poor ones are shouted."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.8)
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "s", "er"]))
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, rng.choice(["en", "de"]), "s", len(text)))
        labels.append((i, good, toxic))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_accuracy(spark, name):
    rows, labels = corpus(900)
    l_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [r for r in awkward() if r[0] is None or r[0] not in range(900)]
    docs = clashing(frame(spark, rows + extra))
    run = toxicity.toxicity_scores if name == "toxic" else quality.quality_scores
    got = run(docs, clashing(l_df)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: (t if name == "toxic" else q) for i, q, t in labels}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got
             if r["doc_id"] in truth and r["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (True if r["doc_id"] is None else held(r["doc_id"]))
    # The score is of the text alone: the same model scores other columns alike.
    again = run(docs.withColumns({"source": docs["lang"]}), l_df).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted(
        (str(r["doc_id"]), r["score"]) for r in got)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, awkward())
    for run in (toxicity.toxicity_scores, quality.quality_scores):
        got = run(docs, none).collect()
        assert len(got) == len(awkward()) and len({r["score"] for r in got}) == 1
        assert run(frame(spark, []), none).collect() == []
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 0, 1), (999, 1, 1)],
                                "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity_scores, quality.quality_scores):
        assert len(run(docs, odd).collect()) == len(awkward())


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = corpus(300, 4)
    docs = frame(spark, rows)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    for run in (toxicity.toxicity_scores, quality.quality_scores):
        a, b = (sorted((r["doc_id"], r["score"]) for r in run(
            docs, spark.createDataFrame(x, schema)).collect()) for x in (labels, flipped))
        assert a == b


def test_scores_do_not_depend_on_batches():
    rows, labels = corpus(300, 1)
    texts = [r[1] for r in rows]
    for model in (toxicity.train(texts, np.array([x[2] for x in labels])),
                  quality.train(texts, np.array([x[1] for x in labels]))):
        some = [*texts[:20], "", None, "a", "a b", "word " * 100_000]
        one = np.concatenate([model.score([t]) for t in some])
        assert np.allclose(model.score(some), one, atol=1e-6)


def plain_features(raw):
    """Buckets of the words and character n-grams of one text, byte by byte."""
    from recspark.llm.words import BASE

    mask = (1 << 64) - 1

    def spread(h):
        for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * times & mask
        return h ^ h >> 33

    out = [spread(sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(w)) + len(w) & mask) >> 48
           for w in raw.split()]
    for n in quality.GRAMS:
        for at in range(max(len(raw) + 2 - n, 0)):
            h = 0
            for b in (raw + b" ")[at:at + n]:
                h = h * BASE + b + 1 & mask
            out.append((spread(h) + n & mask) >> 48)
    return out


def test_quality_scores_one_feature_at_a_time():
    """Averages of learned weights over words and n-grams, by a plain hash."""
    rows, labels = corpus(200, 3)
    model = quality.train([r[1] for r in rows], np.array([x[1] for x in labels]))
    for text in [r[1] for r in rows[:15]] + ["", None, "a", "ab c", "Größe\tnaïve \n", "x" * 50]:
        found = plain_features((text or "").encode())
        margin = sum(float(model.weights[f]) for f in found) / max(len(found), 1) + model.bias
        want = 1 / (1 + np.exp(-(model.slope * margin + model.offset)))
        assert model.score([text])[0] == pytest.approx(want, abs=1e-6)


def test_pooling_looks_at_every_window():
    rng = np.random.default_rng(0)
    rows, labels = corpus(60, 2)
    model = toxicity.train([r[1] for r in rows], np.array([x[2] for x in labels]))
    ids = rng.integers(0, toxicity.BUCKETS, (3, 7))
    got = model.pooled(ids, np.array([0, 5, 5, 7]))[0]
    embed = sum(model.embed[i] for i in ids)
    for row, (a, b) in zip(got, ((0, 5), (5, 5), (5, 7))):
        want = []
        for f, bias, width in zip(model.filters, model.biases, toxicity.WIDTHS):
            x = np.concatenate((embed[a:b], np.zeros((3, toxicity.DIMENSIONS))))
            n = max(b - a - width + 1, 1)
            acts = np.array([x[k:k + width].ravel() @ f for k in range(n)])
            want += list(np.maximum(acts.max(axis=0) + bias, 0))
        assert np.allclose(row, want, atol=1e-4)


def test_logistic_fit():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < sigmoid(2 * z - 1)).astype(float)
    a, b = fit_offset(z, y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.2
