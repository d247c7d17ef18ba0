from collections import defaultdict

import pytest
from helpers import WORD, awkward, clashing, frame

from recspark.llm import mixing
from recspark.llm.oracle import OP9


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing the excess until none is above its end."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    ends, fixed = {s: most * sizes[s] for s in names}, {}
    total = share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if w[s] * level > ends[s]]
        if not over:
            return fixed | {s: w[s] * level for s in rest}
        fixed |= {s: float(ends[s]) for s in over}


def test_mix(spark):
    rows = awkward()
    got = mixing.mix(clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = water(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    again = mixing.mix(frame(spark, rows[::-1], parts=5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, None, None, None)])).collect()
            ] == [0]


def test_a_larger_target_only_adds_documents(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "en", "ab"[i % 2], 0) for i in range(300)]
    df = frame(spark, rows)
    last = {}
    for share in (0.2, 0.5, 0.9, 1.3, 1.9):
        now = {r["doc_id"]: r["copies"] for r in mixing.mix(df, share=share).collect()}
        assert all(now[k] >= v for k, v in last.items())
        last = now


def test_refinement_reaches_single_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP_BITS", 4)
    rows = [(i, "w " * (i % 13), "en", "a" if i % 3 else "b", 0) for i in range(400)]
    got = mixing.mix(frame(spark, rows)).collect()
    for s in "ab":
        part = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 12


def test_mixed_documents_repeat_rows(spark):
    rows = [r for r in awkward() if r[0] is not None]
    df = clashing(frame(spark, rows))
    plan = mixing.mix(df).collect()
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    assert got.count() == sum(r["copies"] for r in plan)


def test_sql_on_awkward_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    rows = awkward()
    con = duckdb.connect()
    con.register("d", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]
                                   ).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    want = sorted(map(str, [(a, b, c, round(t, 4), e) for a, b, c, t, e in
                            con.execute(OP9).fetchall()]))
    got = sorted(map(str, [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 4),
                            r["taken"]) for r in mixing.mix(frame(spark, rows)).collect()]))
    assert got == want
