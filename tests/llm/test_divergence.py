"""The divergence audit against plain Python, and the packed buckets against a dictionary."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, awkward, clashing, frame

from recspark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            for t in TERM.findall(text or "")]


def brute(rows, min_docs=3, top=200):
    docs, count, lang_count = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(terms_of(text))
        docs[lang].update(found.keys())
        count[lang, source].update(found)
        lang_count[lang].update(found)
    kept = {g[0]: [t for t, n in docs[g[0]].items() if n >= min_docs] for g in groups}

    def shares(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(terms)) for t in terms}

    out = []
    for lang, source in groups:
        terms = kept[lang]
        p, q = shares(count[lang, source], terms), shares(lang_count[lang], terms)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                o = shares(count[lang, other], terms)
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in terms), other.encode()))
        best = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in terms
                      if count[lang, source][t] and p[t] > q[t])[:top]
        for part, found in (("pair", sorted(pairs)), ("term", best)):
            out += [(lang, source, part, item.decode(), -v, r + 1)
                    for r, (v, item) in enumerate(found)]
    return sorted(out)


def got(df, **kwargs):
    return sorted(map(tuple, divergence.audit(df, **kwargs).collect()))


def test_against_brute_force(spark):
    rows = awkward() + [(None, "Ünïcode ünïcode straße", None, s, 0) for s in "abca"]
    assert got(clashing(frame(spark, rows))) == brute(rows)


def test_ranks_are_cut_per_group_and_ties_go_by_bytes(spark):
    rows = [(i, " ".join(f"{c}{d}" for c in "abcdefgh" for d in "éz"), "en", "x", 0)
            for i in range(3)] + [(9, "zz zz zz", "en", "y", 0)] * 3
    assert got(frame(spark, rows), top_terms=5) == brute(rows, top=5)


def test_languages_without_kept_terms_and_empty_tables(spark):
    rows = [(1, "once", "en", "a", 0), (2, None, "en", "b", 0), (3, "", None, None, 0)]
    assert got(frame(spark, rows)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert got(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("held, step", [(64, 1 << 20), (10**6, 200), (40, 64)])
def test_counter_against_a_dictionary(monkeypatch, held, step):
    """Short, 16-byte and long terms, long documents cut into pieces, early hand-overs."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "STEP_BYTES", step)
    rng = np.random.default_rng(5)
    words = ["a", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "q" * 17, "ß" * 40, "é", "漢" * 300,
             "x" * 16 + "y", "x" * 32, "x" * 33]
    texts = [" 12,".join(words[k] for k in rng.integers(0, len(words), n))
             for n in (0, 1, 5, 30, 7, 400)]
    counter, want, seen = divergence.TermCounter(), defaultdict(lambda: [0, 0]), Counter()
    docs = Counter()

    def take():
        for group, term, n, d in counter.take():
            for key in zip(group.tolist(), term.to_pylist(), strict=True):
                assert key[1]
            for g, t, a, b in zip(group.tolist(), term.to_pylist(), n.tolist(), d.tolist(),
                                  strict=True):
                seen[g, t] += a
                docs[g, t] += b

    for i, text in enumerate(texts):
        raw = text.encode()
        if len(raw) > step:
            counter.add_long(raw, i % 2)
        else:
            counter.add([raw], np.array([i % 2]))
        for t, n in Counter(terms_of(text)).items():
            want[i % 2, t][0] += n
            want[i % 2, t][1] += 1
        if counter.full():
            take()
    take()
    assert {k: [seen[k], docs[k]] for k in seen} == dict(want)


def test_radix_order_is_stable_and_complete():
    rng = np.random.default_rng(0)
    low = rng.integers(0, 1 << 63, 500).astype(np.uint64) & np.uint64(0xF00000000000000F)
    high = rng.integers(0, 3, 500).astype(np.uint64)
    assert (divergence.radix_order([low, high]) == np.lexsort((low, high))).all()
