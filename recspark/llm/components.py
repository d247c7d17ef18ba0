"""Connected components of a stored edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b``; the label is the smallest node it is joined with.

    In a round every node points to its smallest neighbour, pointers are followed twice, and edges
    are rewritten to what their ends point to. At least every node but the smallest of its
    neighbourhood disappears, so few rounds are needed; hot nodes cost one row per edge.
    """
    live = stored(edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while live.take(1):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("to"))
        for _ in range(2):
            up = stored(up, "pointers")
            over = up.select(F.col("node").alias("to"), F.col("to").alias("far"))
            up = up.join(over, "to").select("node", F.col("far").alias("to"))
        up = stored(up, "pointers")
        if labels is None:
            labels = up.select("node", F.col("to").alias("label"))
        else:
            labels = stored(labels.join(
                up.select(F.col("node").alias("label"), "to"), "label", "left"
            ).select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = live
        for end in ("a", "b"):
            ends = ends.join(up.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")),
                             end)
        live = stored(ends.filter("to_a <> to_b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
        ).distinct(), "edges")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
