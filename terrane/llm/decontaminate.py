"""Benchmark decontamination by an FM-index for each shard of documents.

A shard is a run of whole documents of about `shard_words` words within a partition. Words become numbers of the test
phrases' vocabulary; a run of words that is too short to hold a phrase, or that is outside the vocabulary, becomes one
separator, which no phrase holds. The shard's Burrows-Wheeler transform is kept in a wavelet matrix. All phrases (the
windows of the benchmark's items) are searched backward at once by its ranks; occurrences are located by walking to
sampled suffix positions; overlapping hits are merged to spans.

Phrases are broadcast in batches of at most `batch_bytes` of item text. A larger benchmark takes more batches, which
are applied one after the other to the same rows: each batch's findings are a table, and its broadcast is destroyed,
before the next one is gathered, so nothing on the driver grows with the benchmark. Nothing is shuffled.

Defined results: null texts, and texts and items without words, have no windows and no hits; an item of fewer than
`window` words is one window; repeated items and rows each count, item ids once a document; a null item id is the
empty string; columns of the documents travel as one struct, so clashing names do no harm. An empty benchmark gives
no hits, and no documents give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize

WINDOW = 10
#: Bytes to white space: all ASCII but letters and digits.
BREAKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
FOUND = "n_words long, spans array<array<int>>, items array<string>"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(BREAKS).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of a sequence that ends in its only smallest symbol, by prefix doubling."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, k = len(s), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-k or None] = rank[k:] + 1 if k else rank + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        grown = np.empty(n, np.int64)
        grown[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if grown[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = grown, k * 2


class FMIndex:
    """Wavelet matrix of the transform, with counts of smaller symbols and every `step`-th suffix position."""

    def __init__(self, s: np.ndarray, step: int = 8) -> None:
        sa = suffix_array(s)
        bwt = s[sa - 1].astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.bits = max(1, int(s.max()).bit_length())
        self.levels, self.zeros, row = [], [], bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.bwt, self.step = bwt, step
        self.marked = np.concatenate([[0], np.cumsum(sa % step == 0)])
        self.sampled = sa[sa % step == 0]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbols occur in the transform before places."""
        start, end = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            s1, e1 = ones[start], ones[end]
            start, end = np.where(one, zeros + s1, start - s1), np.where(one, zeros + e1, end - e1)
        return end - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of symbols, all of a length -> the rows that occur and their ranges of suffixes."""
        kept = np.flatnonzero((phrases < len(self.before) - 1).all(1))
        low, high = np.zeros(len(kept), np.int64), np.full(len(kept), len(self.bwt), np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[kept, j]
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            some = low < high
            kept, low, high = kept[some], low[some], high[some]
        return kept, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes: steps back until a sampled one."""
        out, walked, left, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(left):
            sampled = self.marked[at + 1] > self.marked[at]
            out[left[sampled]] = self.sampled[self.marked[at[sampled]]] + walked
            left, at, walked = left[~sampled], at[~sampled], walked + 1
            c = self.bwt[at]
            at = self.before[c] + self.rank(c, at)
        return out


class Phrases:
    """Vocabulary and windows of a batch of items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        listed = [(i, w) for i, text in items if (w := words_of(text))]
        vocabulary = sorted({w for _, words in listed for w in words})
        self.number = {w: k + 2 for k, w in enumerate(vocabulary)}  # 0 ends a shard, 1 separates
        of: dict[tuple[int, ...], set[str]] = {}
        for i, words in listed:
            ids = [self.number[w] for w in words]
            for at in range(max(1, len(ids) - window + 1)):
                of.setdefault(tuple(ids[at : at + window]), set()).add(i)
        self.groups = {}
        for length in sorted({len(p) for p in of}):
            rows = [p for p in of if len(p) == length]
            self.groups[length] = np.array(rows, np.int64), [of[p] for p in rows]
        self.shortest = min(self.groups, default=0)

    def hits(self, docs: list[np.ndarray]) -> dict[int, list[tuple[int, int, int, int]]]:
        """Of a shard, documents as numbers (0: outside the vocabulary): document -> (start, end, length, phrase)."""
        if not self.groups:
            return {}
        sequence = np.concatenate([x for d in docs for x in (d, [0])])
        owner = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
        place = np.concatenate([np.arange(len(d) + 1) for d in docs])
        inside = sequence > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        if not long.any():
            return {}
        take = np.concatenate([np.arange(a, b + 1) for a, b in zip(starts[long], ends[long], strict=True)])
        text = np.concatenate([np.where(inside[take], sequence[take], 1), [0]])
        index = FMIndex(text)
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for length, (rows, _) in self.groups.items():
            kept, low, high = index.search(rows)
            if len(kept):
                which = np.repeat(kept, high - low)
                first = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
                at = take[index.locate(first)]
                for d, p, w in zip(owner[at].tolist(), place[at].tolist(), which.tolist(), strict=True):
                    out.setdefault(d, []).append((p, p + length, length, w))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans; what stands between two of them goes too."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def _searcher(held, window: int, shard_words: int):
    """A scalar iterator function that adds the findings of one batch of items to those before."""

    def search(frames: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        phrases = Phrases(held.value, window)
        number = phrases.number.get
        for series, before in frames:
            texts, at, rows = series.tolist(), 0, []
            spans, items = [[tuple(s) for s in x] for x in before["spans"]], [set(x) for x in before["items"]]
            while at < len(texts):
                first, size, numbered = at, 0, []
                while at < len(texts) and (size < shard_words or at == first):
                    words = words_of(texts[at])
                    numbered.append(np.fromiter(map(number, words, [0] * len(words)), np.int64, len(words)))
                    size, at = size + len(words), at + 1
                rows += [len(x) for x in numbered]
                for d, hits in phrases.hits(numbered).items():
                    spans[first + d] = merged(spans[first + d] + list({(a, b) for a, b, _, _ in hits}))
                    items[first + d] |= set().union(*(phrases.groups[n][1][w] for n, w in {(n, w) for _, _, n, w in hits}))
            yield pd.DataFrame({"n_words": np.array(rows, np.int64), "spans": [[list(s) for s in x] for x in spans], "items": [sorted(x) for x in items]})

    return F.pandas_udf(search, FOUND).asNondeterministic()


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = 300_000, batch_bytes: int = 16 << 20) -> DataFrame:
    """row (the input's), n_words, spans (merged, in words, end exclusive) and items (ids with an occurring window, sorted)."""
    spark = docs.sparkSession
    wanted = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    batches = max(1, math.ceil(total / batch_bytes))
    nothing = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), nothing.alias("found"))
    for k in range(batches):
        part = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == k) if batches > 1 else wanted
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])
        # Only texts and findings go to Python, as one scalar column; the other columns stay where they are.
        out = out.withColumn("found", _searcher(held, window, shard_words)(F.col("row.text"), F.col("found")))
        if batches > 1:  # One batch at a time: its findings are a table before the next one is gathered.
            out = materialize(out, "decontaminate-found")
            held.destroy()
    return out.select("row", "found.*")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove_spans(found: DataFrame) -> DataFrame:
    """row and text: the texts with the found spans cut out."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else without(t, [tuple(s) for s in x]) for t, x in zip(texts, spans, strict=True)])

    text = F.col("row.text")
    return found.select("row", F.when(F.size("spans") > 0, cut(text, "spans")).otherwise(text).alias("text"))
