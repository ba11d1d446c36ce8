"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize


def _minimum(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("at"), F.least("at", "least").alias("least"))


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest neighbour. The minima are a table of their own, so that the join of a hub's many neighbours can be split."""
    both = _mirrored(edges)
    joined = both.join(materialize(_minimum(both), "minima"), F.col("u") == F.col("at"))
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    joined = edges.join(least.withColumnRenamed("u", "at"), F.col("u") == F.col("at"))
    moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(u, v) -> (node, root) for every node of an edge; root is the smallest node it reaches.

    Rounds grow with the logarithm of the longest path. A round's edges are a table in the shared folder, so that
    lineage stays short and a lost executor costs one round's tasks at most; nothing is gathered on the driver but a
    count and a checksum. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    state, mark = materialize(ordered, tag), None
    while True:
        found = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if found["n"] == 0 or (found["n"], found["x"]) == mark:
            break
        mark = (found["n"], found["x"])
        state = materialize(_small(_large(state)), tag)
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
