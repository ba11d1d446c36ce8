"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

1. Sources share all words by weight; no target passes `most` times its source's size, and what is over is
   shared anew by weight, down to the level at which all of it is placed.
2. A source's documents are hashed into blocks of about `block_words` words and rows, in a permuted order. Its quota of
   blocks is each block as often as the target holds the source whole, then permuted blocks up to the target. The last
   block of a quota is drawn in part: documents of it fill what is left, as near as one document.
3. The quotas are split over output shards by a binary tree: at each node the left half's share of every source is
   drawn from the multivariate hypergeometric law, so quotas stay exact and shards are as if all blocks had been
   permuted globally. A shard draws its quota as the next run of each source's permuted blocks, and orders its rows by
   a hash. How often a document is taken is the number of draws of its block, over all shards.

Every draw is a hash of names, so reruns agree. What later steps read more than once (sizes, targets, the tree's levels,
blocks, boundary documents) is a small table without texts; texts are read once for their sizes and, for the mixed rows
themselves, once more.

Defined results: a null or empty text has no words and is drawn with its block; a null source is a source, last in
order; a source without words has target 0; rows of the same source, doc_id and text are taken alike; clashing column
names do no harm, since the row travels as one struct. An empty table gives an empty result. Sources (not documents) are
sorted in one task, and their quotas are one array for each node of the tree: their number is that of a mixture's
sources, thousands, not documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import WORD, materialize, unit

SEED = 6
PART = "struct<source:string,quota:bigint>"
#: Words of rows of about 64 MB, the size of a piece of a shard.
PIECE_WORDS = 10_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash() -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id", F.crc32(F.encode("text", "UTF-8")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size -> with weight and target. The level is that of the first source, by cap over weight, that stays under its cap."""
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_cap = every.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    named = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    spilled = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    return (
        sizes.withColumn("weight", named)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", spilled / F.sum("weight").over(onward))
        .withColumn("nth", F.row_number().over(by_cap))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("nth"))).over(every))
        .withColumn("level", F.max(F.when(F.col("nth") == F.col("first"), F.col("level"))).over(every))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .drop("cap", "ratio", "level", "nth", "first")
    )


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` from `total`, of which `marked` are marked, are marked: the inverse of the law at u.

    The law is walked over 12 deviations about its mean, beyond which it has no weight in double precision.
    """
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.when(n > 1, d * (k / n) * (1 - k / n) * (n - d) / (n - 1)).otherwise(0.0))) * 12 + 2
    low = F.greatest(F.lit(0.0), d - (n - k), F.floor(mean - spread).cast("double"))
    high = F.greatest(low, F.least(d, k, F.ceil(mean + spread).cast("double")))
    steps = F.sequence(low.cast("long"), high.cast("long"))
    up = lambda x: (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))
    walked = F.aggregate(
        steps, F.struct(F.lit(1e-200).alias("p"), F.lit(0.0).alias("sum")),
        lambda a, x: F.struct(F.when(x < high, a["p"] * up(x.cast("double"))).otherwise(0.0).alias("p"), (a["sum"] + a["p"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.aggregate(
        steps, F.struct(F.lit(1e-200).alias("p"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at"), walked.alias("all")),
        lambda a, x: F.struct(
            F.when(x < high, a["p"] * up(x.cast("double"))).otherwise(0.0).alias("p"), (a["sum"] + a["p"]).alias("sum"),
            F.when(a["at"].isNull() & (a["sum"] + a["p"] >= u * a["all"]), x).otherwise(a["at"]).alias("at"), a["all"].alias("all"),
        ),
        lambda a: F.coalesce(a["at"], high.cast("long")),
    )


def _halved(nodes: DataFrame) -> DataFrame:
    """A level of the tree (low, high, parts) -> the next one: each node of several shards becomes its two halves."""
    width = F.col("high") - F.col("low")
    half = F.floor(width / 2).cast("int")
    pool = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["quota"])

    def step(a, p):
        u = unit(F.xxhash64(F.lit(SEED), F.col("low"), F.col("high"), p["source"]))
        left = hypergeometric(a["pool"], p["quota"], a["seats"], u)
        part = F.struct(p["source"].alias("source"), left.alias("quota"))
        return F.struct((a["pool"] - p["quota"]).alias("pool"), (a["seats"] - left).alias("seats"), F.concat(a["left"], F.array(part)).alias("left"))

    start = F.struct(pool.alias("pool"), F.floor(pool * half / width).cast("long").alias("seats"), F.expr(f"cast(array() as array<{PART}>)").alias("left"))
    both = nodes.withColumn("left", F.when(width > 1, F.aggregate("parts", start, step, lambda a: a["left"])))
    right = F.zip_with("parts", "left", lambda p, q: F.struct(p["source"].alias("source"), (p["quota"] - q["quota"]).alias("quota")))
    middle = F.col("low") + half
    node = lambda low, high, parts: F.struct(low.alias("low"), high.alias("high"), parts.alias("parts"))
    low, high = F.col("low"), F.col("high")
    children = F.when(width > 1, F.array(node(low, middle, F.col("left")), node(middle, high, right))).otherwise(F.array(node(low, high, F.col("parts"))))
    return both.select(F.explode(children).alias("n")).select("n.*")


def split(quotas: DataFrame, shards: int) -> DataFrame:
    """source, quota -> source, ends: array of the running total of the shards' exact parts of the quota."""
    parts = F.array_sort(F.collect_list(F.struct("source", F.col("quota").cast("long").alias("quota"))))
    nodes, wide = quotas.groupBy().agg(parts.alias("parts")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "parts"), shards
    while wide > 1:
        nodes, wide = materialize(_halved(nodes), "mixing-tree"), -(-wide // 2)
    each = nodes.select("low", F.explode("parts").alias("p")).select("low", "p.source", "p.quota")
    total = F.sum("quota").over(Window.partitionBy("source").orderBy("low"))
    ends = F.transform(F.array_sort(F.collect_list(F.struct("low", "end"))), lambda x: x["end"])
    return each.withColumn("end", total).groupBy("source").agg(ends.alias("ends"))


def _with(rows: DataFrame, lookup: DataFrame, *key: str) -> DataFrame:
    """rows, joined to the lookup's row of the same source (null is one) and key."""
    named = lookup.withColumnsRenamed({c: f"_{c}" for c in ("source", *key)})
    on = rows["source"].eqNullSafe(named["_source"])
    for c in key:
        on = on & (rows[c] == named[f"_{c}"])
    return rows.join(named, on).drop("_source", *[f"_{c}" for c in key])


def _ranked(blocks: DataFrame) -> DataFrame:
    """source, block, words -> with rank and end (the words up to the block) in the source's permuted order.

    The order is dealt into runs by its first bits: a source's runs are summed in one task, its blocks are not.
    """
    placed = blocks.withColumn("place", F.xxhash64(F.lit(SEED + 1), "source", "block")).withColumn("run", F.shiftrightunsigned("place", 54))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("source", "run").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    runs = runs.select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    within = Window.partitionBy("source", "run").orderBy("place", "block")
    here = placed.withColumn("nth", F.row_number().over(within) - 1).withColumn("sum", F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return _with(here, runs, "run").select("source", "block", "words", (F.col("n_before") + F.col("nth")).alias("rank"), (F.col("w_before") + F.col("sum")).alias("end"))


def _filled(edge: DataFrame) -> DataFrame:
    """source, h, size, open of the boundary blocks' documents -> source, h, kept: sizes come near `open`.

    A few rounds, each of a window over one block: what fits in hashed order, then what fits of the rest, then one more,
    the nearest in size to what is still left, if the sum comes nearer by it.
    """
    source = Window.partitionBy("source")
    edge = edge.withColumn("kept", F.lit(False))
    held = F.col("open") - F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).over(source)
    for order in (F.col("h"), F.col("size").desc(), F.col("size").desc()):
        upto = source.orderBy(F.col("fits").desc(), order, "h").rowsBetween(Window.unboundedPreceding, 0)
        fits = ~F.col("kept") & (F.col("size") <= F.col("left"))
        more = F.col("fits") & (F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(upto) <= F.col("left"))
        edge = materialize(edge.withColumn("left", held).withColumn("fits", fits).withColumn("kept", F.col("kept") | more).drop("left", "fits"), "mixing-edge")
    gap = F.when(~F.col("kept"), F.abs(F.col("size") - F.col("left")))
    nearest = F.row_number().over(source.orderBy(F.col("gap").asc_nulls_last(), "h"))
    last = edge.withColumn("left", held).withColumn("gap", gap).withColumn("nearest", nearest)
    one = F.coalesce((F.col("nearest") == 1) & (F.col("gap") < F.col("left")), F.lit(False))
    return last.select("source", "h", (F.col("kept") | one).alias("kept"))


class Mix:
    """The decisions of a mix, as tables: `sized` (one row for each document, without texts), `plan`, `blocks` and `edge`."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, shards: int = 8, block_words: int = 200_000) -> None:
        self.shards = shards
        self.sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash().alias("h")), "mixing-sizes")
        sizes = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int")
        rest = F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long")
        parts = F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("n")) / block_words)).cast("long")
        planned = targets(sizes, weights, most).withColumn("whole", whole).withColumn("rest", rest).withColumn("parts", parts)
        self.plan = materialize(planned.drop("n", "weight"), "mixing-plan")

        # Blocks of a prefix of the permuted order are drawn once more; of the last of them (part) only `open` words are.
        ranked = _with(_ranked(self._dealt(self.sized).groupBy("source", "block").agg(F.sum("size").alias("words"))), self.plan)
        extra = F.coalesce((F.col("end") - F.col("words") < F.col("rest")) & (F.col("words") > 0), F.lit(False))
        ranked = materialize(ranked.withColumn("extra", extra).withColumn("part", extra & (F.col("end") > F.col("rest"))), "mixing-ranks")
        drawn = ranked.groupBy("source").agg(F.count("*").alias("n_blocks"), F.max("whole").alias("whole"), F.coalesce(F.max(F.when(F.col("extra"), F.col("rank") + 1)), F.lit(0)).alias("more"))
        ends = split(drawn.select("source", (F.col("whole") * F.col("n_blocks") + F.col("more")).alias("quota")), shards)
        # The c-th draw of a block is the draw c * n_blocks + rank of its source; the tree's ends tell its shard, the last end whether it is one.
        draw = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda c: c * F.col("n_blocks") + F.col("rank"))
        draws = F.filter(draw, lambda d: d < F.element_at("ends", -1))
        shard = F.transform(draws, lambda d: F.size(F.filter("ends", lambda e: e <= d)))
        blocks = _with(_with(ranked, drawn.select("source", "n_blocks")), ends)
        opened = F.when(F.col("part"), F.col("rest") - F.col("end") + F.col("words"))
        self.blocks = materialize(blocks.select("source", "block", shard.alias("shards"), opened.alias("open")), "mixing-blocks")

        edge = _with(self._dealt(self.sized.filter("size > 0")), self.blocks.filter("open is not null"), "block")
        self.edge = materialize(_filled(edge.groupBy("source", "h", "open").agg(F.sum("size").alias("size"))), "mixing-filled")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return _with(rows, self.plan.select("source", "parts")).withColumn("block", F.pmod("h", "parts")).drop("parts")

    def drawn(self, rows: DataFrame) -> DataFrame:
        """rows (source, h ...) with shards, the shard of each copy taken, and order, its place within the shard."""
        here = _with(self._dealt(rows), self.blocks, "block")
        edge = self.edge.select(F.col("source").alias("_source"), F.col("h").alias("_h"), "kept")
        here = here.join(edge, here["source"].eqNullSafe(edge["_source"]) & (here["h"] == edge["_h"]), "left").drop("_source", "_h")
        left_out = F.col("open").isNotNull() & ~F.coalesce("kept", F.lit(False))
        taken = F.when(left_out, F.slice("shards", F.lit(1), F.size("shards") - 1)).otherwise(F.col("shards"))
        here = here.withColumn("shards", taken).drop("block", "open", "kept")
        return here.withColumn("order", F.transform("shards", lambda s, c: F.xxhash64(F.lit(SEED + 2), c, "h")))

    def digest(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, copies, shards, order of each document."""
        rows = _with(self.drawn(self.sized), self.plan.select("source", "source_size", "target")).withColumn("copies", F.size("shards"))
        return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "shards", "order")

    def rows(self, docs: DataFrame) -> DataFrame:
        """The mix itself: each taken copy as a row of the input's columns, shard by shard, shuffled within pieces of a shard."""
        words = self.plan.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("n")).first()["n"]
        pieces = max(1, int(words / PIECE_WORDS / self.shards))
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        drawn = self.drawn(docs.select(row, "source", row_hash().alias("h")))
        copies = drawn.select("row", F.explode(F.arrays_zip("shards", "order")).alias("copy"))
        placed = copies.select("row", F.col("copy.shards").alias("shard"), F.floor(unit(F.col("copy.order")) * pieces).alias("piece"), F.col("copy.order").alias("order"))
        return placed.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "order").select("row.*")
