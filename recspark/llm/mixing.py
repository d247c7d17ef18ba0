"""Mixing sources to target weights by nested hash thresholds, with built-in functions only.

Every document has a hash. A source that needs a share of itself takes the documents whose hash lies
below a threshold, so a larger target only ever adds documents. Thresholds come from sums of sizes
by (source, hash bucket): the bucket in which the budget runs out is split into finer buckets until
it holds one hash, and no other row is looked at again. Nothing is sorted or collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, stored

# Bits of the document hash and bits that one refinement looks at.
HASH_BITS = 60
STEP_BITS = 12


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of a digest of id and text; rows that repeat both share it."""
    digest = F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
        F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
            most: int = 2) -> DataFrame:
    """``source, source_size, target`` from per-source sizes: one row per source in and out.

    Weights are dealt to the sources in code-point order, null last. A target ends at ``most`` times
    its source's size and the excess goes to the others by weight: with level ``x``, every target is
    ``least(most * size, weight * x)``. The level is found on the sources in the order in which they
    reach their ends.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place)
    whole = W.partitionBy()
    ends = sizes.withColumn("_w", weight).withColumn("_end", F.lit(most) * F.col("source_size"))
    order = W.orderBy(F.col("_end") / F.col("_w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumns({
        "_pos": F.row_number().over(order),
        "_full": F.sum("_end").over(upto),
        "_left": F.sum("_w").over(whole) - F.sum("_w").over(upto),
        "_all": F.sum("source_size").over(whole) * F.lit(float(share)),
    })
    reached = F.col("_full") + F.col("_end") / F.col("_w") * F.col("_left") >= F.col("_all")
    level = (F.col("_all") - F.col("_full") + F.col("_end")) / (F.col("_left") + F.col("_w"))
    ends = ends.withColumn("_x", F.min(
        F.when(reached, F.struct(F.col("_pos"), level.alias("x")))).over(whole)["x"])
    # Beyond what all sources can give, every target is at its end.
    return ends.select(
        "source", "source_size",
        F.coalesce(F.least(F.col("_end").cast("double"), F.col("_w") * F.col("_x")),
                   F.col("_end").cast("double")).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, source_size, target, passes, below`` with ``passes`` whole copies of a source and
    one more copy of its documents with a hash under ``below``.

    ``rows`` has ``source, size, h``; ``plan`` is the result of :func:`targets`.
    """
    passes = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = stored(plan.withColumn("passes", passes.cast("long")), "mix-plan")
    # Source, hash prefix reached, and words still wanted out of that prefix's documents.
    edge = plan.select(
        F.col("source"), F.lit(0).cast("long").alias("prefix"),
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("need"),
    ).filter(F.col("need") > 0)
    depth, done = 0, []
    while True:
        depth += STEP_BITS
        e = edge.alias("e")
        inside = rows.alias("r").join(
            e, F.col("r.source").eqNullSafe(F.col("e.source"))
            & (F.shiftright("r.h", HASH_BITS - depth + STEP_BITS) == F.col("e.prefix")))
        sums = inside.groupBy(
            F.col("e.source").alias("source"), F.col("e.need").alias("need"),
            F.shiftright("r.h", HASH_BITS - depth).alias("prefix"),
        ).agg(F.sum("r.size").alias("size"), F.min("r.h").alias("low"), F.max("r.h").alias("high"))
        upto = F.sum("size").over(W.partitionBy("source").orderBy("prefix"))
        found = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("need"))
        first = found.groupBy("source").agg(F.min_by(
            F.struct("prefix", "size", "low", "high",
                     (F.col("need") - F.col("upto") + F.col("size")).alias("need")),
            "prefix").alias("b")).select("source", "b.*")
        first = stored(first, "mix-edge")
        single = F.col("low") == F.col("high")
        # Documents that share one hash go together: in, if that comes nearer to the target.
        taken = F.when(F.col("need") * 2 >= F.col("size"), F.col("low") + 1).otherwise(F.col("low"))
        done.append(first.filter(single).select("source", taken.alias("below")))
        edge = first.filter(~single).select("source", "prefix", "need")
        if depth >= HASH_BITS or not edge.take(1):
            break
    ends = reduce(DataFrame.unionByName, done)
    p, t = plan.alias("p"), ends.alias("t")
    return p.join(t, F.col("p.source").eqNullSafe(F.col("t.source")), "left").select(
        "p.*", F.coalesce("t.below", F.lit(0)).cast("long").alias("below"))


def fit(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2,
        seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Stored narrow rows ``doc_id, source, size, h`` of all documents and the stored plan by
    source: ``source, source_size, target, passes, below``."""
    rows = stored(docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
        document_hash(F.col("doc_id"), F.col("text"), seed).alias("h"),
    ), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, stored(thresholds(rows, targets(sizes, weights, share, most)), "mix-thresholds")


def _planned(rows: DataFrame, plan: DataFrame, h: Column) -> DataFrame:
    """``rows`` with ``_copies`` and its source's plan under ``p``."""
    r, p = rows.withColumn("_h", h).alias("r"), plan.alias("p")
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).withColumn(
        "_copies", F.col("p.passes") + (F.col("_h") < F.col("p.below")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2,
        seed: int = 0) -> DataFrame:
    """How often each document enters the mix: ``doc_id, source, size, source_size, target,
    copies, taken``, one row per row of ``docs``.

    Sizes are words. Null texts have size 0, null sources are a source of their own, rows without an
    id are hashed by their text. A source without words has target 0. Rows that repeat id and text
    are taken together. Reruns give the same mix. Extra columns are ignored; no rows give no rows.
    """
    rows, plan = fit(docs, weights, share, most, seed)
    return _planned(rows, plan, F.col("h")).select(
        "r.doc_id", "r.source", "r.size", "p.source_size", "p.target",
        F.col("_copies").alias("copies"), (F.col("r.size") * F.col("_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                    most: int = 2, seed: int = 0) -> DataFrame:
    """The mix itself: every row of ``docs``, with its own columns, as often as :func:`mix` says."""
    _, plan = fit(docs, weights, share, most, seed)
    h = document_hash(F.col("doc_id"), F.col("text"), seed)
    taken = _planned(docs, plan, h).filter("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return taken.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
