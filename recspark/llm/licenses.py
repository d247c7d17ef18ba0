"""Licence scan: TF-IDF cosine of lines, windows of lines and whole files to licence templates, and
inheritance from the nearest licensed directory, with built-in functions only.

A text is cut into lines and sentences. Terms, those outside the templates too, are weighted by their
document frequency over all files. A line can only reach the threshold of a
template through terms that carry enough of the template's weight, so lines without any such anchor
term are dropped before anything is exploded. Notices of several lines are compared with windows of
consecutive lines as long as the notice, long licence texts with whole files; both only where a
file's terms carry enough of the template's weight.
"""

from __future__ import annotations

import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import stored, table
from .license_notices import LONG_TEXTS, NOTICES

# Short public licence notices, as they are written.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
# Cosine from which a line is a template's, and share of a text's terms in such lines from which the
# text is a licence file of its directory.
THRESHOLD = 0.6
# The same for windows and whole files. Higher, since long texts share their common words.
WINDOW_THRESHOLD = 0.8
FILE_SHARE = 0.25

_TERM = r"[a-z0-9]+"


def _terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def _lines(text: str) -> Column:
    """Lines of a text, ended also by a full stop, ! or ? before a blank."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), r"[\r\n]+")


def _vectors(templates, idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """Templates as weights of length one."""
    out = []
    for name, text in templates:
        words = re.findall(_TERM, text.lower())
        raw = {t: words.count(t) * idf[t] for t in words}
        size = sqrt(sum(w * w for w in raw.values()))
        out.append((name, {t: w / size for t, w in raw.items()}))
    return out


def anchors(vectors: list[tuple[str, dict[str, float]]], threshold: float) -> set[str]:
    """Terms without which no line reaches the threshold of any template.

    The cosine with a template is at most the length of its weights over the shared terms, so per
    template the heaviest terms are anchors until the rest is shorter than the threshold.
    """
    found: set[str] = set()
    for _, vector in vectors:
        rest = sorted(vector.items(), key=lambda x: (-x[1], x[0]))
        left = 1.0
        for term, w in rest:
            if left < threshold * threshold - 1e-9:
                break
            found.add(term)
            left -= w * w
    return found


def _frequencies(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``term, files``: in how many files each term is; of terms outside ``vocabulary`` only those of
    more than one file."""
    terms = files.select(
        F.explode(F.array_distinct(_terms(F.coalesce("text", F.lit(""))))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("files")).filter(
        (F.col("files") > 1) | F.col("term").isin(vocabulary))


def matches(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, notices=NOTICES,
            texts=LONG_TEXTS) -> DataFrame:
    """``file, license, score, share`` of the files that have a line of a template, a window of lines
    of a notice, or are one of the long texts.

    ``files`` has ``file, text``. The best match counts, ties go to the smaller name; ``share`` is
    the part of the file's terms that lies in lines of any match. At most one number per template
    term reaches the driver.
    """
    spark = files.sparkSession
    long = (*notices, *texts)
    vocabulary = sorted(_flat((*templates, *long)))
    total = files.count()
    counts = stored(_frequencies(files, vocabulary), "license-terms")
    df = dict(counts.join(_terms_table(spark, vocabulary), "term", "left_semi").collect())
    idf = {t: log((1 + total) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    lines = _matching_lines(files, _vectors(templates, idf), counts, total, threshold)
    if long:
        lines = lines.unionByName(_matching_windows(
            files, _vectors(long, idf), [len(re.findall(_TERM, t.lower())) for _, t in notices],
            counts, total))
    # A line may be in several matches.
    by_line = lines.groupBy("file", "line").agg(
        F.first("terms").alias("terms"), F.first("length").alias("length"),
        F.min("best").alias("best"))
    return by_line.groupBy("file").agg(
        F.min("best").alias("best"),
        (F.sum("length") / F.first("terms")).alias("share"),
    ).select("file", F.col("best.license").alias("license"),
             (-F.col("best.far")).alias("score"), "share")


def _terms_table(spark: SparkSession, terms) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")


def _weight(total: int) -> Column:
    """Weight of a term by ``files``; those without a stored count are in one file."""
    return F.log((1.0 + total) / (1 + F.coalesce("files", F.lit(1)))) + 1


def _matching_lines(files: DataFrame, vectors, counts: DataFrame, total: int,
                    threshold: float) -> DataFrame:
    """``file, line, terms, length, best`` of single lines that match a template."""
    spark = files.sparkSession
    rows = [(k, name, t, w) for k, (name, v) in enumerate(vectors) for t, w in v.items()]
    weights = spark.createDataFrame(rows, "template int, license string, term string, w double")
    pattern = r"(?i)\b(" + "|".join(sorted(anchors(vectors, threshold))) + r")\b"
    lines = files.filter(F.col("text").rlike(pattern)).select(
        "file", F.size(_terms(F.col("text"))).alias("terms"),
        F.posexplode(_lines("text")).alias("line", "body"),
    ).filter(F.col("body").rlike(pattern))
    counted = lines.select("file", "terms", "line", _terms(F.col("body")).alias("t")).select(
        "file", "terms", "line", F.size("t").alias("length"), F.explode("t").alias("term")
    ).groupBy("file", "line", "term").agg(
        F.first("terms").alias("terms"), F.first("length").alias("length"),
        F.count(F.lit(1)).alias("n"))
    weighed = counted.join(counts, "term", "left").withColumn("x", F.col("n") * _weight(total))
    size = weighed.groupBy("file", "line").agg(
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"),
        F.first("terms").alias("terms"), F.first("length").alias("length"))
    dots = weighed.join(weights, "term").groupBy("file", "line", "template", "license").agg(
        F.sum(F.col("x") * F.col("w")).alias("dot"))
    found = dots.join(size, ["file", "line"]).withColumn(
        "score", F.round(F.col("dot") / F.col("size"), 9)).filter(F.col("score") >= threshold)
    return found.groupBy("file", "line").agg(
        F.first("terms").alias("terms"), F.first("length").cast("long").alias("length"),
        F.min(F.struct((-F.col("score")).alias("far"), "license")).alias("best"))


def _matching_windows(files: DataFrame, vectors, lengths: list[int], counts: DataFrame,
                      total: int) -> DataFrame:
    """``file, line, terms, length, best`` of the lines in windows that match a notice, or of whole
    files that match a long text.

    The first vectors are those of notices of ``lengths`` terms; a window takes the lines that begin
    within so many terms of its first line.
    """
    spark = files.sparkSession
    least = WINDOW_THRESHOLD * WINDOW_THRESHOLD - 1e-9
    ks = range(len(vectors))
    terms = sorted({t for _, v in vectors for t in v})
    wide = spark.createDataFrame(
        [(t, *[v.get(t, 0.0) for _, v in vectors]) for t in terms],
        "term string, " + ", ".join(f"w{k} double" for k in ks))
    # The cosine is at most the length of the template's weights over the file's terms.
    reach = files.select("file", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(
        F.broadcast(wide), "term").groupBy("file").agg(
        *[F.sum(F.col(f"w{k}") * F.col(f"w{k}")).alias(f"r{k}") for k in ks])
    near = stored(reach.select("file", F.filter(
        F.array(*[F.when(F.col(f"r{k}") >= least, F.lit(k)) for k in ks]),
        lambda k: k.isNotNull()).alias("templates")).filter(F.size("templates") > 0),
        "license-near")
    tokens = files.join(near, "file", "left_semi").select(
        "file", F.posexplode(_lines("text")).alias("line", "body")).select(
        "file", "line", F.explode(_terms(F.col("body"))).alias("term"))
    tokens = stored(tokens.groupBy("file", "line", "term").agg(F.count(F.lit(1)).alias("n")).join(
        counts, "term", "left").withColumn("idf", _weight(total)).drop("files"), "license-tokens")
    lines = stored(tokens.join(F.broadcast(wide), "term", "left").groupBy("file", "line").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("idf") * F.col("idf")).alias("q"),
        *[F.coalesce(F.sum(F.col("n") * F.col("idf") * F.col(f"w{k}")), F.lit(0.0)).alias(f"d{k}")
          for k in ks]), "license-sums")
    at = lines.withColumn("at", F.sum("n").over(
        W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["at"])
    # The sum of squared counts is at least the sum of counts, so sums over the window bound the
    # cosine from above.
    frames = []
    for k, m in enumerate(lengths):
        w = W.partitionBy("file").orderBy("at").rangeBetween(0, m - 1)
        frames.append(F.when(
            F.sum(f"d{k}").over(w) >= (WINDOW_THRESHOLD - 1e-9) * F.sqrt(F.sum("q").over(w)),
            F.struct(F.lit(k).alias("template"), F.max("line").over(w).alias("end"))))
    starts = at.select("file", F.col("line").alias("start"), F.array(*frames).alias("hits")).select(
        "file", "start", F.explode(F.filter("hits", lambda h: h.isNotNull())).alias("h")).select(
        "file", "start", "h.template", "h.end")
    whole = lines.groupBy("file").agg(F.min("line").alias("start"), F.max("line").alias("end")).join(
        near, "file").select("file", "start", F.explode("templates").alias("template"), "end").filter(
        F.col("template") >= len(lengths))
    pairs = near.select("file", F.explode("templates").alias("template"))
    windows = starts.join(pairs, ["file", "template"], "left_semi").unionByName(whole)
    inside = windows.withColumn("line", F.explode(F.sequence("start", "end")))
    weights = spark.createDataFrame(
        [(k, t, w) for k, (_, v) in enumerate(vectors) for t, w in v.items()],
        "template int, term string, w double")
    names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(vectors)],
                                  "template int, license string")
    x = inside.join(tokens, ["file", "line"]).groupBy("file", "template", "start", "term").agg(
        (F.sum("n") * F.first("idf")).alias("x"))
    found = x.join(weights, ["template", "term"], "left").groupBy("file", "template", "start").agg(
        F.round(F.sum(F.col("x") * F.coalesce("w", F.lit(0.0))) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 9)
        .alias("score")).filter(F.col("score") >= WINDOW_THRESHOLD).join(names, "template")
    sizes = lines.groupBy("file").agg(F.sum("n").alias("terms"))
    return inside.join(found, ["file", "template", "start"]).join(
        lines.select("file", "line", "n"), ["file", "line"]).join(sizes, "file").groupBy(
        "file", "line").agg(
        F.first("terms").cast("int").alias("terms"), F.first("n").alias("length"),
        F.min(F.struct((-F.col("score")).alias("far"), "license")).alias("best"))


def _flat(templates) -> dict[str, float]:
    return {t: 1.0 for _, text in templates for t in re.findall(_TERM, text.lower())}


def _directory(path: str = "path") -> Column:
    """Everything before the last slash; the root is the empty string."""
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, root included."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(
        F.array(F.lit("")),
        F.transform(F.sequence(F.lit(1), F.size(parts)),
                    lambda k: F.array_join(F.slice(parts, 1, k), "/"))))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD,
         file_share: float = FILE_SHARE) -> DataFrame:
    """``file, path, license, how, score, from_directory``: one row per row of ``files``.

    ``files`` has ``file`` (a unique id), ``path`` and ``text``. A file's own licence is that of its
    best line. A directory has the licence most of its licence files have (ties: smaller name);
    licence files are named LICENSE, LICENCE or COPYING, or consist of licence lines to
    ``file_share``. Files without an own licence inherit from the nearest directory above that has
    one. Null texts have no own licence, null paths lie in the root, files without any licence get
    nulls. Other columns are ignored; no rows give no rows.
    """
    rows = files.select("file", F.coalesce("path", F.lit("")).alias("path"), "text")
    own = stored(matches(rows, templates, threshold), "license-lines")
    placed = stored(rows.select("file", "path", _directory().alias("directory")), "license-paths")
    named = F.regexp_replace("path", "^.*/", "").rlike(r"(?i)^(licen[sc]e|copying)([.-].*)?$")
    votes = own.join(placed, "file").filter((F.col("share") >= file_share) | named).groupBy(
        "directory", "license").agg(F.count(F.lit(1)).alias("n"))
    licensed = votes.groupBy("directory").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "license"))["license"].alias("inherited"))
    # Directories, not files, look upwards: one row per directory and level.
    above = placed.select("directory").distinct().select(
        "directory", F.explode(_ancestors(F.col("directory"))).alias("up"))
    nearest = above.join(licensed.withColumnRenamed("directory", "up"), "up").groupBy(
        "directory").agg(F.max_by(F.struct("up", "inherited"), F.length("up")).alias("near"))
    return placed.join(own, "file", "left").join(nearest, "directory", "left").select(
        "file", "path",
        F.coalesce("license", "near.inherited").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(
            F.col("near").isNotNull(), "inherited").alias("how"),
        "score",
        F.when(F.col("license").isNull(), F.col("near.up")).alias("from_directory"))


def document_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over ``documents``. The table has no paths: a quarter each of the documents lie in
    ``<source>`` and ``<source>/<lang>``, the others in ``<source>/<lang>/<id mod 100>``."""
    docs = table(spark, sf_dir, "documents")
    level = F.pmod("doc_id", F.lit(4))
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("none")),
        F.when(level > 0, F.coalesce("lang", F.lit("none"))),
        F.when(level > 1, F.pmod("doc_id", F.lit(100)).cast("string")),
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text"))
    return found.select(F.col("file").alias("doc_id"), "path", "license", "how",
                        F.round("score", 6).alias("score"), "from_directory")
