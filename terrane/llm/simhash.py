"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint's 64 bits are cut into `blocks` blocks. Two fingerprints that differ in at most `distance` bits agree
on at least blocks - distance blocks, so each choice of that many blocks is a key, and close pairs meet under one key
at least. Fingerprints, not documents, are keyed: copies have collapsed before. Within a key the distances are
verified, and what is passed on is a forest that spans the links found there, never all pairs.

A key with over `bucket` fingerprints is cut anew: its fingerprints agree on the bits of the key, and those that are
close agree on one of distance + 1 parts of the rest at least. With 11 free bits or fewer a key cannot hold over 2048
fingerprints, so every bucket is bounded in the end and no link is lost.

Defined results: a null or empty text, or one of white space, has fingerprint zero; fewer words than a shingle make one
shingle of all; repeated rows and ties link like any other; a null doc_id gets its component's smallest id and never
is one; other columns are kept out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize
from terrane.llm.components import components

SEED = 42


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> int:
    """The bits set in over half of n hashes, as a signed integer."""
    value = int("".join("1" if x else "0" for x in (2 * total > n)), 2)
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    grams = zip(*[words[i:] for i in range(shingle)], strict=False) if len(words) >= shingle else [words]
    total, n = np.zeros(64, np.int64), 0
    while True:
        part = np.fromiter((digest(b" ".join(g), seed) for g in islice(grams, 1 << 16)), ">u8") if not isinstance(grams, list) else np.array([digest(b" ".join(grams[0]), seed)], ">u8")
        if not len(part):
            break
        total += bit_sums(part)
        n += len(part)
        if isinstance(grams, list):
            break
    return majority(total, n)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, shingle) for t in texts), np.int64, len(texts)))

    return docs.select("doc_id", of("text").alias("fp"))


def _masks(bits: list[int], parts: int, agree: int) -> list[int]:
    """Signed masks of the choices of `agree` of `parts` parts of the bits."""
    cut = [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]
    masks = [sum(1 << b for part in chosen for b in part) for chosen in combinations(cut, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_masks(distance: int = 3, blocks: int = 6) -> list[int]:
    """Fingerprints that differ in at most `distance` bits agree under one of these masks at least."""
    return _masks(list(range(64)), blocks, blocks - distance)


def _free(mask: int) -> list[int]:
    return [b for b in range(64) if not (mask >> b) & 1]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (u, smaller v) that connect what is within the distance, a spanning forest."""
    left, out = fps, []
    while len(left) > 1:  # a component at a time: breadth first from its first fingerprint
        root, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(wave), 256):
                near |= (np.bitwise_count(wave[at : at + 256, None] ^ left[None, :]) <= distance).any(0)
            wave, left = left[near], left[~near]
            out += [(int(x), int(root)) for x in wave]
    return out


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, bucket: int = 2048) -> DataFrame:
    """Distinct fingerprints fp -> (u, v): a graph with the components of 'differ in at most `distance` bits'."""
    spark = fps.sparkSession
    # Fixed-size lookup of masks: as many as choices of blocks, times distance + 1 for each finer cut.
    masks = block_masks(distance, blocks)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks])).alias("b")).select("fp", "b.mask", "b.key")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [pair for group in pdf["fps"] for pair in forest(np.sort(np.asarray(group, np.int64)), distance)]
            yield pd.DataFrame({"u": np.array([u for u, _ in out], np.int64), "v": np.array([v for _, v in out], np.int64)})

    out = None
    while True:
        size = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        shared = materialize(keyed.join(size, ["mask", "key"]), "simhash-buckets")
        small = shared.filter(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = small.mapInPandas(verified, "u long, v long")
        out = found if out is None else out.unionByName(found)
        large = shared.filter(F.col("n") > bucket)
        if large.isEmpty():
            return out
        finer = [(m, f) for m in masks for part in _masks(_free(m), distance + 1, 1) for f in [_signed(m | part)]]
        masks = sorted({f for _, f in finer})
        lookup = spark.createDataFrame(finer, "mask long, finer long")
        keyed = large.join(F.broadcast(lookup), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")).distinct()


def _signed(mask: int) -> int:
    mask &= (1 << 64) - 1
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links)."""
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), distance, blocks), "simhash-components")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
