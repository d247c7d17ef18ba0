import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from helpers import SCHEMA, awkward, clashing, frame

from recspark.llm import exact_dedup


def test_trie_agrees_with_a_dictionary():
    rng = random.Random(1)
    trie, want = exact_dedup.PatriciaTrie(), {}
    for _ in range(3000):
        key = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 9)))
        row = rng.choice([None, rng.randint(0, 50)])
        trie.insert(key, row, 1, row, True)
        old = want.get(key, (None, 0))
        ids = [x for x in (old[0], row) if x is not None]
        want[key] = (max(ids) if ids else None, old[1] + 1)
    assert len(trie.terminals) == len(want)
    for key, (best, n) in want.items():
        assert trie.terminal(key).owner[:2] == [best, n]


def test_subtrees_are_cut_whole_and_the_rest_goes_on():
    rng = random.Random(2)
    trie, want = exact_dedup.PatriciaTrie(), {}
    for n in range(2000):
        key = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 12)))
        trie.insert(key, n, 1, n, True)
        want[key] = n
        if n % 100 == 99:
            before = len(trie.terminals)
            cut = trie.cut()
            assert cut and before == len(trie.terminals) + len(cut)
            for found, row_id, *_ in cut:
                assert want.pop(found) == row_id
            assert trie.size == sum(map(len, want))
    assert {bytes(k): v for k, v in want.items()} == {
        k: trie.terminal(k).owner[0] for k in want}
    while trie.terminals:
        trie.cut()
    assert trie.size == 0


def _through(monkeypatch, rows, sorted_keys, trie_bytes, batch=7):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", trie_bytes)
    batches = [pa.RecordBatch.from_pylist(
        [dict(zip(("_id", "_text", "_key", "_n"), r)) for r in rows[k:k + batch]])
        for k in range(0, len(rows), batch)]
    return [r for b in exact_dedup._collapse(True, sorted_keys)(iter(batches)) for r in b.to_pylist()]


def test_repeated_texts_stay_while_others_are_spilled(monkeypatch):
    """A text between ever new ones is handed over far less often than it comes."""
    rows = []
    for i in range(600):
        rows.append((2 * i, "the one that comes back", 5, 1))
        rows.append((2 * i + 1, f"{i:04d} only once", i, 1))
    out = _through(monkeypatch, rows, False, 400)
    mine = [r for r in out if r["_text"] == "the one that comes back"]
    assert sum(r["_n"] for r in mine) == 600 and max(r["_id"] for r in mine) == 1198
    assert len(mine) < 20 and len(out) - len(mine) == 600


def test_copies_of_one_key_hold_one_row(monkeypatch):
    """Half of all rows are one long text from ever new tasks: what is held stays small."""
    text = "long " * 200
    rows = [(i, text, 1, 3) for i in range(4000)] + [(9000 + i, f"t{i}", 2 + i, 1) for i in range(50)]
    most = 0
    take = exact_dedup.PatriciaTrie.insert

    def insert(self, key, row_id, count, place, largest):
        nonlocal most
        most = max(most, place[0])
        return take(self, key, row_id, count, place, largest)

    monkeypatch.setattr(exact_dedup.PatriciaTrie, "insert", insert)
    out = _through(monkeypatch, rows, True, 5000)
    assert sorted((r["_id"], r["_n"]) for r in out)[0] == (3999, 12000) and len(out) == 51
    assert most < 10


def expected(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for i, text, *_ in rows:
        ids = [x for x in groups[text or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[text or ""]), i == keep,
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_decisions(spark):
    rows = awkward()
    got = exact_dedup.decisions(clashing(frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert exact_dedup.decisions(frame(spark, [])).collect() == []


def test_small_tries_give_up_their_subtrees(monkeypatch):
    rows = [(i, f"text {i % 40}", i % 40, 1) for i in range(400)]
    rows.sort(key=lambda r: r[2])
    batches = [pa.RecordBatch.from_pylist(
        [dict(zip(("_id", "_text", "_key", "_n"), r)) for r in rows[k:k + 7]])
        for k in range(0, 400, 7)]
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 50)
    out = [r for b in exact_dedup._collapse(True, True)(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["_text"], r["_id"], r["_n"]) for r in out) == sorted(
        (f"text {k}", 360 + k, 10) for k in range(40))


def test_owners_keep_whole_rows_and_smallest(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = exact_dedup.owners(clashing(frame(spark, rows)), keep="smallest").collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[1] or ""].append(r)
    assert len(got) == len(texts)
    for r in got:
        group = texts[r["text"] or ""]
        assert (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) in group
        assert r["doc_id"] == min(g[0] for g in group) and r["group_size"] == len(group)
        assert r["score"] == "x"
    with pytest.raises(ValueError):
        exact_dedup.owners(spark.createDataFrame([], SCHEMA), keep="any")
