from math import log, sqrt
from textwrap import wrap

from helpers import clashing

from recspark.llm import licenses

SCHEMA = "file long, path string, text string"
ROWS = [
    (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person "
                     "obtaining a copy of this software and associated documentation files (the "
                     "\"Software\")"),
    (2, "a/x/y/code.py", "def f(): pass"),
    (3, "a/b/code.py", "Some words. " * 20 + "\nLicensed under the Apache License, Version 2.0.\nMore words."),
    (4, "a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."),
    (5, "a/b/c/d.txt", None), (6, "top.txt", "under the version of this work"), (7, None, ""),
    (8, "z/note.txt", "This work is licensed under the GNU General Public License, version 3."),
    (9, "z/other.txt", "nothing"), (10, "az/other.txt", "nothing"),
    (11, "q/long.txt", "filler words here " * 20_000 + ". Released under the MIT License."),
    (12, "q/tie.txt", "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
]


def test_own_and_inherited(spark):
    got = {r["file"]: (r["license"], r["how"], r["from_directory"]) for r in licenses.scan(
        clashing(spark.createDataFrame(ROWS, SCHEMA).selectExpr(
            "file as file2", "path as path2", "text")).drop("file", "path").selectExpr(
            "file2 as file", "path2 as path", "text", "score", "size", "label")).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "own", None),
        4: ("CC-BY-NC-4.0", "own", None), 5: ("CC-BY-NC-4.0", "inherited", "a/b"),
        6: (None, None, None), 7: (None, None, None), 8: ("GPL-3.0", "own", None),
        9: ("GPL-3.0", "inherited", "z"), 10: (None, None, None), 11: ("MIT", "own", None),
        12: ("CC-BY-NC-4.0", "own", None)}


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_anchors_are_needed():
    idf = licenses._flat(licenses.TEMPLATES)
    vectors = licenses._vectors(licenses.TEMPLATES, idf)
    found = licenses.anchors(vectors, 0.6)
    for _, v in vectors:
        assert sum(w * w for t, w in v.items() if t not in found) < 0.36


def test_terms_outside_templates_weigh_by_their_files(spark):
    """One more word in the line: a common one keeps the score high, a rare one lowers it."""
    rows = [(k, f"d/{k}", "see project") for k in range(400)]
    rows += [(1000, "m/a", "Released under the MIT License see"),
             (1001, "m/b", "Released under the MIT License zyzzyva")]
    got = {r["file"]: r["score"] for r in licenses.matches(
        spark.createDataFrame(rows, SCHEMA)).collect()}

    def idf(n):
        return log((1 + 402) / (1 + n)) + 1

    def score(n):  # five template words, each in both lines only
        return round(5 * idf(2) ** 2 / sqrt(5) / idf(2) / sqrt(5 * idf(2) ** 2 + idf(n) ** 2), 6)

    assert {k: round(v, 6) for k, v in got.items()} == {1000: score(401), 1001: score(1)}


def test_headers_and_licence_files(spark):
    """Wrapped headers in comments, whole licence files, and texts that only share common words."""
    notices = {n: t for n, t in licenses.NOTICES}
    texts = dict(licenses.LONG_TEXTS)

    def header(name, width=64):
        return "\n".join("# " + x for x in wrap(notices[name], width))

    code = "\n".join(f"def name{k}(value): return value + {k}" for k in range(60))
    rows = [(1, "a/gpl.py", "# Copyright 2020 Some One\n" + header("GPL-3.0") + "\n" + code),
            (2, "b/isc.c", code + "\n" + header("ISC", 40)),
            (3, "c/LICENSE", "Copyright (c) 2020\n\n" + notices["Unlicense"]),
            (4, "d/COPYING", texts["GPL-3.0"]), (5, "e/COPYING", texts["LGPL-2.1"]),
            (6, "f/lgpl.c", header("LGPL-3.0", 300)),
            (7, "g/prose.txt", "The program is free for the user of the software and the author. " * 30),
            (8, "h/bsd", header("BSD-2-Clause"))]
    got = {r["file"]: (r["license"], r["how"]) for r in licenses.scan(
        spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("GPL-3.0", "own"), 2: ("ISC", "own"), 3: ("Unlicense", "own"),
                   4: ("GPL-3.0", "own"), 5: ("LGPL-2.1", "own"), 6: ("LGPL-3.0", "own"),
                   7: (None, None), 8: ("BSD-2-Clause", "own")}
