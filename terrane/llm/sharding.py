"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A row descends from regions to racks to shards. At each node every child draws ln(u) / weight, with u from
a hash of the row's key and the child's name; the largest draw wins. A child's draw depends on its own name
and weight alone, so a weight that changes moves rows only into or out of the subtree that it belongs to.

Law `key`: the key and the number of shards decide. Shards fill regions of `racks` x `per_rack` in order, so
a shard that opens a region (the ninth of the default tree) takes rows only into itself; one that joins an
existing rack moves rows only within, or into, the region that holds it.

Defined results: a null text has size 1 and the checksum of an empty text; rows of the same key (null is one)
share a shard and get a slot each; of equal rows, slots are dealt in any order; other columns are kept out
unless named in `keep`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import unit

SEED = 5


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> list:
    """Nested lists, regions of racks of shard numbers."""
    numbers = list(range(shards))
    groups = [numbers[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [groups[i : i + racks] for i in range(0, len(groups), racks)]


def _weight(node, weights: dict[int, float]) -> float:
    return weights.get(node, 1.0) if isinstance(node, int) else sum(_weight(x, weights) for x in node)


def descend(key: Column, node, weights: dict[int, float] | None = None, name: str = "root") -> Column:
    """The shard that a key reaches."""
    if isinstance(node, int):
        return F.lit(node)
    if len(node) == 1:
        return descend(key, node[0], weights, f"{name}/0")
    draws = [F.struct((F.log(unit(F.xxhash64(F.lit(SEED), F.lit(f"{name}/{i}"), key))) / F.lit(_weight(child, weights or {}))).alias("draw"), F.lit(i).alias("child")) for i, child in enumerate(node)]
    won, out = F.array_max(F.array(*draws))["child"], None
    for i, child in enumerate(node):
        below = descend(key, child, weights, f"{name}/{i}")
        out = F.when(won == i, below) if out is None else out.when(won == i, below)
    return out


def assign(docs: DataFrame, shards: int = 8, weights: dict[int, float] | None = None, rows_per_bucket: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns of `keep`.

    Slots: rows of a shard are dealt by a hash into buckets, numbered within a bucket, and shifted by the
    number of rows in the buckets before. No task holds a shard, whatever the shards' size.
    """
    text, key = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        descend(key, tree(shards), weights).alias("shard"), descend(key, tree(shards + 1), weights).alias("grown_shard"), *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep],
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "text_crc32", "size"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), "grown_shard", *[F.col(f"`kept_{c}`").alias(c) for c in keep])
