"""toxicity is learned from every labelled text, not from a sample alone."""

import numpy as np
from helpers import frame
from test_classifiers import corpus, held

from recspark.llm import toxicity

SCHEMA = "doc_id long, quality int, toxic int"


def test_a_word_outside_the_sample_is_learned(spark):
    """Long toxic texts hold a word of their own; the sample takes 60 short texts of each class."""
    rows, labels = corpus(700, 5)
    rows = [(i, t if len(t) < 900 else t[:900], *rest) for i, t, *rest in rows]
    for k in range(300):
        rows.append((5000 + k, rows[k][1].replace("gromp", "w").replace("snarv", "w").replace(
            "blixo", "w") + (" zzqqv" if k % 2 else " mmkkt") + " the" * 400, "en", "s", 0))
        labels.append((5000 + k, 1, k % 2))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, SCHEMA)
    run = lambda d: toxicity.fit(d, known, per_class=60, sample_chars=1000)
    model = run(docs)
    fold = [(t, toxic) for (i, t, *_), (_, _, toxic) in zip(rows, labels, strict=True) if held(i)]
    long = [(t, y) for t, y in fold if len(t) > 1000]
    score = model.score([t for t, _ in long])
    y = np.array([y for _, y in long])
    assert len(y) > 30 and score[y == 1].min() > score[y == 0].max()
    right = (model.score([t for t, _ in fold]) >= 0.5) == np.array([y for _, y in fold])
    assert right.mean() > 0.95
    # Whatever the partitions, the model is the same.
    again = run(docs.repartition(7))
    assert np.array_equal(again.embed, model.embed) and again.offset == model.offset
    assert again.by_lang == model.by_lang


def test_copies_of_the_model_are_averaged(spark, monkeypatch):
    rows, labels = corpus(1500, 6)
    docs, known = frame(spark, rows), spark.createDataFrame(labels, SCHEMA)
    monkeypatch.setattr(toxicity, "TASK_CHARS", 60_000)  # four tasks
    model = toxicity.fit(docs, known, per_class=40)
    fold = [(r[1], x[2]) for r, x in zip(rows, labels, strict=True) if held(r[0])]
    right = (model.score([t for t, _ in fold]) >= 0.5) == np.array([y for _, y in fold])
    assert right.mean() > 0.95


def test_a_table_as_large_as_its_sample_is_learned_as_before(spark):
    rows, labels = corpus(200, 7)
    docs, known = frame(spark, rows), spark.createDataFrame(labels, SCHEMA)
    sample, rate = toxicity.training_sample(docs, known, "toxic", lang=True)
    plain = toxicity.train(sample["text"].tolist(), sample["label"].to_numpy(),
                           sample["lang"].tolist(), rate)
    model = toxicity.fit(docs, known)
    assert np.array_equal(plain.embed, model.embed) and plain.offset == model.offset
