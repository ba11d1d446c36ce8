"""Ranked lexical search by the threshold algorithm over shards of documents.

A pass over the texts gives the forward index: of each document its length and its counts of the items' terms. Its
aggregates are the statistics of all documents. Tasks then take the forward index in shards of bounded size. A shard has
a list for each term, sorted by impact; for each item the lists are read round-robin, a growing block of each in turn,
a document met for the first time is looked up in the shard's forward index and scored in full, and reading stops when
the threshold, the sum of the impacts last read, falls strictly below the kth score. So no document that is left unread
can be among the shard's best or tie with them. The best of all shards are merged by rank.

Items are independent of each other: they come in batches of at most `batch_bytes` of text, so that the vocabulary and
the statistics that a pass broadcasts are bounded whatever the number of items.

Defined results: null and empty texts have no terms and are in no statistic; an item without terms, or whose terms stand
in no document, has no rows; items that repeat each have their own ranks, also under one item_id; equal scores are in the
order of doc_id, a null one last; columns other than those named are not read; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import materialize

#: Lower case for A-Z, a space for every byte of ASCII that is in no term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Entries of each list that the first round of an item reads; every round reads twice as many as the one before.
FIRST_BLOCK = 16


def terms(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(FOLD).split()


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight one adds to a document's score."""
    m = 25 + (75 * length * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard:
    """The forward index of some documents and, of each term, the places in it by falling impact."""

    def __init__(self, lengths, starts, term, tf, weight, n_docs, n_terms):
        self.starts, self.term = starts, term
        self.owner = np.repeat(np.arange(len(lengths)), np.diff(starts))
        self.impact = weight[term] * impacts(tf, lengths[self.owner], n_docs, n_terms)
        order = np.lexsort((-self.impact, term))
        self.listed_docs, self.listed_impact, self.sorted_terms = self.owner[order], self.impact[order], term[order]

    def lookup(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from their rows of the forward index."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        return np.add.reduceat(self.impact[rows] * asked[self.term[rows]], ends - sizes)

    def best(self, item: dict[int, int], asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, in any order: the k highest and all that tie with the kth, or more. `asked` holds an item's counts by term."""
        ids = np.fromiter(item, np.int64)
        low, high = np.searchsorted(self.sorted_terms, ids), np.searchsorted(self.sorted_terms, ids, "right")
        lists = [(a, b, item[t]) for t, a, b in zip(ids.tolist(), low.tolist(), high.tolist(), strict=True) if a < b]
        seen = np.zeros(len(self.starts) - 1, bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, block = 0, FIRST_BLOCK
        while True:
            met = [self.listed_docs[a + depth : min(b, a + depth + block)] for a, b, _ in lists]
            new = np.concatenate(met) if met else np.zeros(0, np.int64)
            new = np.unique(new[~seen[new]])
            depth, block = depth + block, 2 * block
            if len(new):
                seen[new] = True
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.lookup(new, asked)])
            threshold = sum(times * int(self.listed_impact[a + depth - 1]) for a, b, times in lists if a + depth < b)
            if len(scores) > k:
                kth = np.partition(scores, -k)[-k]
                docs, scores = docs[scores >= kth], scores[scores >= kth]
            if threshold == 0 or (len(scores) >= k and threshold < scores.min()):
                return docs[scores > 0], scores[scores > 0]


def forward_index(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (all terms with repeats), terms (numbers of the vocabulary's terms), tfs."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            lengths, term_lists, tf_lists = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                counted = Counter(t for t in map(number.get, words) if t is not None)
                lengths.append(len(words))
                term_lists.append(list(counted.keys()))
                tf_lists.append(list(counted.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(term_lists, pa.list_(pa.int32())), pa.array(tf_lists, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(index, "doc_id long, n long, terms array<int>, tfs array<long>")


def _searched(index: DataFrame, items, k: int, shard_postings: int) -> DataFrame:
    """q (an item's number), doc_id, score: each shard's best of each item."""

    def flat(batch: pa.RecordBatch, name: str) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name)).flatten()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_items, weight, n_docs, n_terms = items.value

        def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            lengths = table["n"].to_numpy()
            sizes = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            term, tf = (np.concatenate([flat(p, c).to_numpy() for p in parts]).astype(np.int64) for c in ("terms", "tfs"))
            shard, asked = Shard(lengths, starts, term, tf, weight, n_docs, n_terms), np.zeros(len(weight), np.int64)
            found, names = ([], [], []), table["doc_id"].combine_chunks()
            ids = names.fill_null(np.iinfo(np.int64).max).to_numpy()
            for q, item in enumerate(asked_items):
                for t, times in item.items():
                    asked[t] = times
                docs, scores = shard.best(item, asked, k)
                asked[list(item)] = 0
                first = np.lexsort((ids[docs], -scores))[:k]
                for column, values in zip(found, (np.full(len(first), q), docs[first], scores[first]), strict=True):
                    column.append(values)
            q, docs, scores = (np.concatenate(c) for c in found)
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), names.take(pa.array(docs)), pa.array(scores, pa.int64())], ["q", "doc_id", "score"])

        held, postings = [], 0
        for batch in batches:
            held.append(batch)
            postings += len(flat(batch, "terms"))
            if postings >= shard_postings:
                yield told(held)
                held, postings = [], 0
        if sum(map(len, held)):
            yield told(held)

    return index.filter(F.size("terms") > 0).mapInArrow(search, "q long, doc_id long, score long")


def _one_batch(docs: DataFrame, batch: list, k: int, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    asked = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(r["text"])) for r in batch]
    held = [spark.sparkContext.broadcast(vocabulary)]
    index = materialize(forward_index(docs, held[0]), "lexical-forward", "zstd")
    totals = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # no more rows than the batch has terms
        df[r["t"]] = r["df"]
    held.append(spark.sparkContext.broadcast(([dict(c) for c in asked], weights(totals["docs"], df), totals["docs"], totals["terms"])))
    best = _searched(index, held[1], k, shard_postings)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(batch)], "q long, item_id long")
    out = materialize(ranked.join(names, "q").select("item_id", "rank", "doc_id", "score"), "lexical-ranked")
    for broadcast in held:
        broadcast.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_postings: int = 1_000_000, batch_bytes: int = 16 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k highest-scoring documents with a score above 0."""
    wanted = items.filter(F.octet_length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    batches, out = max(1, math.ceil(total / batch_bytes)), None
    for b in range(batches):
        part = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == b) if batches > 1 else wanted
        ranked = _one_batch(docs, part.collect(), k, shard_postings)
        out = ranked if out is None else out.unionByName(ranked)
    return out
