"""What many symbols reach, in one job: for each node the set of seeds that reached it, as words of 64 bits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(edges: DataFrame, seeds: DataFrame, staged: Callable[[str, DataFrame], DataFrame], types: tuple[str, ...] = (), depth: int = 3, reverse: bool = False) -> DataFrame:
    """seed, id, depth: every seed with what it reaches in at most `depth` hops, at the smallest depth; a seed reaches itself at 0.

    Seeds (id) are numbered; a frontier's row is a node, the number of a word and the 64 seeds of that word that are there.
    A level is one join of the edges with the frontier, whose bits are combined before and after the shuffle, less the bits
    that the node has seen; so an edge is followed once for 64 seeds, and a cycle ends. `staged` makes a table of a level, which
    cuts lineage and plan. It ends early where a level finds nothing. Null ids, seeds and open edges take no part, repeats
    count once; no seeds reach nothing. Rows grow with the pairs that are found, and no step holds one seed's or node's
    pairs in one row: a word has 64 bits.
    """
    near, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    steps = edges.filter(F.col("type").isin(*types)) if types else edges
    steps = steps.filter(F.col(near).isNotNull() & F.col(far).isNotNull()).select(F.col(near).alias("id"), F.col(far).alias("next"))
    numbered = staged("reach-seeds", seeds.select(F.col("id").alias("seed")).filter("seed is not null").distinct().withColumn("n", F.monotonically_increasing_id()))
    levels = [numbered.select(F.col("seed").alias("id"), F.expr("shiftright(n, 6)").alias("word"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bits"))]
    for level in range(1, depth + 1):
        there = steps.join(levels[-1], "id").groupBy(F.col("next").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        seen = reduce(DataFrame.unionByName, levels).groupBy("id", "word").agg(F.bit_or("bits").alias("seen"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        levels.append(staged(f"reach-{level}", there.join(seen, ["id", "word"], "left").select("id", "word", new.alias("bits")).filter("bits <> 0")))
        if levels[-1].isEmpty():
            break
    found = reduce(DataFrame.unionByName, [rows.withColumn("depth", F.lit(level)) for level, rows in enumerate(levels)])
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)
    pairs = found.select("id", "depth", "word", F.explode(held).alias("b")).select("id", "depth", (F.expr("shiftleft(word, 6)") + F.col("b")).alias("n"))
    return pairs.join(numbered, "n").select("seed", "id", "depth")
