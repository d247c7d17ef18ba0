"""Small tables with the awkward cases, and plain Python versions of the operators."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

BASE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"l{i % 977}x{i % 31}" for i in range(40_000))


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows and near copies."""
    rows = [
        (1, BASE, "en", "a", 1), (2, BASE, "en", "b", 1), (3, BASE.upper(), "de", "a", 2),
        (4, BASE + " tail", None, "b", None), (5, None, "en", None, None), (6, "", "fr", "c", 0),
        (7, " \t\n", "en", "a", 3), (8, "one two", "en", "a", 7), (9, "one  two", "en", "b", 8),
        (10, LONG, "en", "a", len(LONG)), (11, LONG + " end", "en", "c", len(LONG)),
        (12, "x" * 30_000, "es", "b", 30_000), (13, "Zwölf Boxkämpfer, größer als!", "de", "b", 9),
        (13, "Zwölf Boxkämpfer, größer als!", "de", "b", 9), (14, None, None, None, None),
        (None, "no id here at all", "en", "a", 4), (None, BASE, "en", "c", 5),
        (15, "It's 12ab <|endoftext|> DON'T stop", "en", "a", 3),
    ]
    return rows + [(100 + i, " ".join(f"r{(i * 7 + k * k) % 97}" for k in range(5 + 9 * i)),
                    "en", "abc"[i % 3], i) for i in range(20)]


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clashing(df):
    """The same table with columns named like what the operators make and use."""
    from pyspark.sql import functions as F

    names = ("score", "size", "shard", "slot", "kept", "keep_id", "group_size", "label", "h", "sig",
             "node", "tie", "ids", "length", "_id", "_text", "_n", "_key", "n_tokens", "target",
             "taken", "component_id", "file", "path", "part", "place", "predicted", "offset")
    return df.withColumns({n: F.lit("x") for n in names})


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def near_components(rows):
    """Component by row number: smallest id of the rows that links reach (None without any)."""
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    common = Counter()
    for v in where.values():
        for a in range(len(v)):
            for b in range(a):
                common[v[b], v[a]] += 1
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            up[max(root(a), root(b))] = min(root(a), root(b))
    best = defaultdict(list)
    for i, r in enumerate(rows):
        best[root(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in best[root(i)] if x is not None]
        out.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    return sorted(out, key=str)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
