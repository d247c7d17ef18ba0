from collections import defaultdict

from helpers import awkward, clashing, crc, frame

from recspark.llm import sharding


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, crc((r[1] or "").encode()))
                  for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(spark):
    rows = awkward()
    check(rows, sharding.shard(clashing(frame(spark, rows)), 7).collect(), 7)
    assert sharding.shard(frame(spark, []), 4).collect() == []
    check(rows[:1], sharding.shard(frame(spark, rows[:1]), 5).collect(), 5)


def test_sizes_are_near_equal_and_copies_lie_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
    rows = [(i, f"t{i // 2} " + "y" * (i // 2 * 37 % 90), "en" if i % 5 else "de",
             f"s{i % 4}", 0) for i in range(2000)]
    rows += [(5000 + i, "hot " * 30, "en", "s1", 0) for i in range(1000)]
    got = sharding.shard(frame(spark, rows), 40).collect()
    check(rows, got, 40)
    size = defaultdict(int)
    where = defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(size.values()) / 40
    assert len(size) == 40 and max(size.values()) < 1.1 * mean > 0.9 * min(size.values())
    assert min(size.values()) > 0.9 * mean
    # A cut falls into at most one group.
    assert sum(len(s) - 1 for s in where.values()) <= 39


def cuts(rows, dims, first, shards, whole, out):
    """Checks a node of the tree by its rows ``(coordinates, size, shard)`` and goes on below it."""
    if shards == 1 or not rows:
        return
    half = shards // 2
    left = [r for r in rows if r[2] < first + half]
    right = [r for r in rows if r[2] >= first + half]
    assert all(first <= r[2] < first + shards for r in rows)
    width = [(max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) / whole[d] if whole[d] else 0
             for d in range(len(dims))]
    axis = max(range(len(dims)), key=lambda d: width[d])
    if left and right:
        assert max(r[0][axis] for r in left) <= min(r[0][axis] for r in right)
    weight = sum(r[1] for r in rows)
    out.append((dims[axis], abs(sum(r[1] for r in left) - weight * half / shards)))
    cuts(left, dims, first, half, whole, out)
    cuts(right, dims, first + half, shards - half, whole, out)


def test_every_cut_is_a_weighted_median_along_the_widest_dimension(spark):
    """Sources that share a long beginning are told apart; sizes and ids decide elsewhere."""
    rows = [(i * i % 7919, f"t{i} " + "y" * (i * 37 % 400), ("en", "de", "fr", "es")[i % 4],
             f"https://common-crawl/{i % 13:02d}", 0) for i in range(1500)]
    placed = sharding.split_tree(sharding._metadata(frame(spark, rows)), 11).collect()
    dims = sharding.DIMENSIONS
    at = [([r[d] for d in dims], r["size"], r["shard"]) for r in placed]
    assert len({r["d_source"] for r in placed}) == 13
    whole = [max(a[0][d] for a in at) - min(a[0][d] for a in at) for d in range(len(dims))]
    found = []
    cuts(at, dims, 0, 11, whole, found)
    assert len(found) == 10 and {d for d, _ in found} >= {"d_source", "d_id"}
    biggest = max(r[1] for r in at)
    assert all(off <= biggest for _, off in found)
