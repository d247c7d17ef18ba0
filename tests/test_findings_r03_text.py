"""Findings of round 3 on review texts: texts are tokenised once, scores follow the pool rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from recspark.operators import textprofiles
from recspark.operators.textprofiles import TextProfiles, term_counts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_tokenised_once(spark):
    """F32, F41: a filter of empty arrays tokenised every text several times more."""
    docs = spark.createDataFrame(
        [(1, "a pen the pen"), (2, "x"), (3, ""), (4, None), (5, "the"), (6, "Red pen")],
        "id int, doc string")
    found = term_counts(docs, "id", ["the"])
    assert {tuple(r) for r in found.collect()} == {
        (1, "pen", 2), (1, "pen pen", 1), (6, "red", 1), (6, "pen", 1), (6, "red pen", 1)}
    assert term_counts(docs, "id", []).count() == term_counts(docs, "id", None).count() == 8
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_extract_all") == 1


@pytest.mark.parametrize("rows", [8192, 3])
def test_scores_are_summed_by_block(spark, monkeypatch, rows):
    """F31, F33, F35-F37: every term of every pool row was a row of the shuffle."""
    monkeypatch.setattr(textprofiles, "BLOCK_ROWS", rows)
    users = [("u1", "a", 0.6), ("u1", "b", 0.8), ("u2", "a", 1.0), ("u3", "only", 1.0), (None, "a", 1.0)]
    items = [(i, t, w) for i in range(20) for t, w in (("a", i / 20), ("b", 0.1), (f"t{i}", 0.5))]
    items += [(None, "a", 1.0)]
    pool = [(u, i) for u in ("u1", "u2", "u3", "u4", None) for i in [*range(22), None]] + [("u1", 3)]
    text = TextProfiles(
        spark.createDataFrame(items, "item_id long, term string, weight double"),
        spark.createDataFrame(users, "user_id string, term string, weight double"), None)
    got = text.score(spark.createDataFrame(pool, "user_id string, item_id long"))
    want = Counter({p: 0.0 for p in pool})
    for u, t, w in users:
        for i, s, v in items:
            if t == s and u is not None and (u, i) in want and i is not None:
                want[u, i] += w * v
    rows_ = got.collect()
    assert len(rows_) == len(want)
    assert {(r.user_id, r.item_id): r.text_sim for r in rows_} == pytest.approx(dict(want))
    plan = _plan(got)
    assert not any("Join" in x and "term" in x and "item_id" in x for x in plan.splitlines())
