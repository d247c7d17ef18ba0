import random

import numpy as np
import pytest
from helpers import awkward, clashing, crc, frame

pytest.importorskip("public_tokenizers")

from recspark.llm import huffman, packing, tokens  # noqa: E402

NAME = "word_bpe_49k.json"


def plain(text):
    return tokens.encoder(NAME)._plain(text or "") + b"\1\0\0\0"


def test_words_have_the_ids_of_whole_texts():
    e = tokens.encoder(NAME)
    assert e.by_word
    rng = random.Random(1)
    letters = "aBcDé İΣσ'̱́ \n\t.,!<|>endoftext019ßÀ KÅ字#&|"
    texts = [r[1] or "" for r in awkward()] + ["<|ENDOFTEXT|> a", "A<|endoftext|>b", "\x1cq \x85"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for t in texts:
        assert e.encode(t) == e._plain(t), repr(t)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1000)
    e = tokens.TextEncoder(tokens.public_path(NAME))
    for t in ("a b c d e f g h", "h i j k", "a b c d e f g h i j k l m n, o. p!"):
        assert e.encode(t) == e._plain(t)


def test_other_tokenizers_encode_whole_texts():
    e = tokens.encoder("byte_bpe_50k.json")
    assert not e.by_word
    assert e.encode("Two  words") == e._plain("Two  words")


@pytest.mark.parametrize("limit", [9, 12, 16])
def test_codes_are_prefix_free_limited_and_near_optimal(limit):
    rng = np.random.default_rng(limit)
    counts = rng.zipf(1.4, 300).astype(np.int64)
    bits = huffman.code_lengths(counts, limit)
    assert bits.max() <= limit and np.sum(2.0 ** -bits.astype(float)) == 1.0
    p = counts / counts.sum()
    entropy = -(p * np.log2(p)).sum()
    assert entropy <= (p * bits).sum() <= entropy + (1 if limit > 9 else 2)
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, int), 2)


def test_blocks_decode(monkeypatch):
    rng = np.random.default_rng(2)
    counts = rng.zipf(1.3, 1000)
    ids = np.sort(rng.choice(60_000, 1000, replace=False))
    book = huffman.Codebook(ids, huffman.code_lengths(counts, 16))
    for n in (1, 2, 255, 256, 257, 5000):
        text = rng.choice(ids, n)
        assert (book.decode(*book.encode(text), n) == text).all()
    one = huffman.Codebook(np.array([7]), huffman.code_lengths(np.array([3]), 16))
    assert one.decode(*one.encode(np.full(300, 7)), 300).tolist() == [7] * 300


def test_roundtrip(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_TOKENS", 300)
    rows = awkward()
    got = huffman.roundtrip(clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    left = sorted((str(r[0]), plain(r[1])) for r in rows)
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
        left.remove((str(r["doc_id"]), bytes(r["ids"])))
    assert not left
    assert huffman.roundtrip(frame(spark, [])).collect() == []


def test_pieces_and_packing(spark):
    rows = awkward()
    got = packing.pack(packing.pieces(clashing(frame(spark, rows)), capacity=512), 512).collect()
    want = []
    for r in rows:
        ids = plain(r[1])
        want += [(str(r[0]), k, at // 4, ids[at:at + 2048])
                 for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], bytes(r["ids"])) for r in got
                  ) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 512
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 512) + 2
    whole = packing.packed_sequences(spark.createDataFrame(got)).collect()
    assert sum(w["length"] for w in whole) == total
    assert all(len(w["ids"]) == 4 * w["length"] for w in whole)
    back = packing.sequence_contents(packing.packed_sequences(spark.createDataFrame(got))).collect()
    place = ("doc_id", "piece", "start", "length", "sequence_id", "offset")
    assert sorted((*[r[c] for c in place], r["ids_crc32"]) for r in back if r["doc_id"] is not None
                  ) == sorted((*[r[c] for c in place], crc(bytes(r["ids"]))) for r in got
                              if r["doc_id"] is not None)
    assert len(back) == len(got)
    assert packing.pack(packing.pieces(frame(spark, []))).collect() == []


def test_texts_together_and_long_texts_in_parts(monkeypatch):
    enc = tokens.TextEncoder(tokens.public_path(NAME))
    texts = [r[1] for r in awkward()] + [None, "", "word " * 50, "x" * 300 + " y\u00a0z"]
    monkeypatch.setattr(tokens, "STEP_BYTES", 40)
    assert enc.encode_all(texts) == [enc._plain(t) if t else b"" for t in texts]
    other = tokens.TextEncoder(tokens.public_path("byte_bpe_50k.json"))
    assert other.encode_all(texts[-4:]) == [other._plain(t) if t else b"" for t in texts[-4:]]


def test_narrow_ids_are_the_same_ids(spark):
    rows = awkward()
    assert packing.narrow(NAME) == 2
    got = packing.packed_pieces(clashing(frame(spark, rows)), capacity=512).collect()
    want = []
    for r in rows:
        ids = plain(r[1])
        want += [(str(r[0]), k, at // 4, crc(ids[at:at + 2048]))
                 for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["ids_crc32"]) for r in got
                  ) == sorted(want)
    assert packing.packed_pieces(frame(spark, [])).collect() == []


def test_the_word_cache_keeps_what_is_in_use(monkeypatch):
    """Two small generations: ids stay those of whole texts, and frequent words are learned once."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 40_000)
    enc = tokens.TextEncoder(tokens.public_path("word_bpe_49k.json"))
    learned = []
    find = enc._learn
    enc._learn = lambda words: learned.extend(w for w in words if w not in enc.older) or find(words)
    rng = np.random.default_rng(5)
    for k in range(120):
        rare = " ".join("".join(rng.choice(list("abcdefgß"), 9)) + "," for _ in range(30))
        text = f"the often Seen words, aren't {rare} Größe naïve (x) 12ab e\u0301"
        assert enc.encode(text) == enc._plain(text)
    assert learned.count(b"often") == 1 and enc.held <= 80_000
    assert len(enc.older) and len(learned) > 3000


def histogram(lengths):
    return {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}


def test_plans_are_valid_and_tight():
    rng = np.random.default_rng(0)
    cases = {
        "short": (rng.integers(1, 50, 20_000), 1),
        "long tail": (np.minimum(4096, np.exp(rng.normal(6.5, 1.1, 50_000)).astype(int) + 1), 30),
        "even": (rng.integers(1, 4097, 20_000), 100),
        "halves": (np.full(100, 2048), 0), "over half": (np.full(100, 2049), 100),
        "whole": (np.full(10, 4096), 0), "one": (np.array([1]), 0)}
    for name, (lengths, slack) in cases.items():
        plan = packing.plan_packing(histogram(lengths))
        used, at = {}, {}
        for n, rank, bins, first, offset, copies in plan.entries:
            assert used.get(n, 0) == rank
            used[n] = rank + bins * copies
            for s in range(first, first + bins):
                assert at.get(s, 0) == offset
                at[s] = offset + n * copies
        assert used == histogram(lengths), name
        assert max(at.values()) <= 4096 and len(at) == plan.sequences
        assert plan.sequences <= -(-int(lengths.sum()) // 4096) + slack, name


def test_least_squares_agree_with_projected_steps():
    rng = np.random.default_rng(3)
    a, b = rng.random((12, 30)), rng.random(12) * 10
    x = packing.nnls(a, b)
    y = np.zeros(30)
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20_000):
        y = np.maximum(y - step * (a.T @ (a @ y - b)), 0)
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-6


def test_crc_of_ids_is_the_built_in_one(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(bytearray(b"\1\0\0\0"),)], "ids binary").select(
        F.crc32("ids").alias("c")).first()
    assert row["c"] == crc(b"\1\0\0\0")
