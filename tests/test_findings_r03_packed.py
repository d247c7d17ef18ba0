"""rows moved twice, and once for the split, with digests of 32 characters in each."""

import random

import pytest

from recspark.operators import split, stats
from recspark.skew import packed, unpacked

KEYS = ["", "0", "00", "ab", "AB", "aB", "abc", "zz", "0g", " ab", "ünïcode", "d41d8cd98f00b204e9800998ecf8427e",
        "D41D8CD98F00B204E9800998ECF8427E", "0" * 31, "f" * 300, None]
SCHEMA = "user_id long, item_id long, rating double, row_key string"


def test_strings_come_back_as_they_were(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(KEYS)], "i long, k string")
    there = packed(df, "k")
    sizes = {r.i: len(r.k) for r in there.collect() if r.k is not None}
    assert sizes[11] == 16 and sizes[12] == 32  # upper case is not what unhex gives back
    assert sorted(tuple(r) for r in unpacked(there, "k").collect()) == list(enumerate(KEYS))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(42)
    return [(rng.choice([None, *range(9)]), rng.choice([None, *range(7)]), float(rng.randint(1, 5)),
             KEYS[i % len(KEYS)] if i % 3 else f"{rng.getrandbits(128):032x}") for i in range(400)]


def test_residuals(spark, rows):
    train = spark.createDataFrame(rows, SCHEMA)
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    mean = lambda x: sum(x) / len(x)
    mu = mean([r[2] for r in rows])
    user = {u: mean([r[2] for r in rows if r[0] == u]) for u in range(9)}
    item = {i: mean([r[2] for r in rows if r[1] == i]) for i in range(7)}
    want = [(*r, round(r[2] - user[r[0]] - item[r[1]] + mu, 6)) for r in known]
    found = stats.residuals(train)
    got = [(r.user_id, r.item_id, r.rating, r.row_key, round(r.residual, 6)) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    moved = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()
             if "unhex" in x and "Project" in x]
    assert moved, "digests are packed below the joins"


def test_the_split_orders_by_the_strings(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = split.split_per_user(df, 0.5)
    assert got.columns == [*df.columns, "split"]
    want = []
    for u in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (
            r[3] is not None, (r[3] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
        want += [(*r, "train" if k < len(mine) // 2 else "test") for k, r in enumerate(mine)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "unhex" in plan and plan.split("== Initial Plan ==")[0].count("Exchange hash") == 1
