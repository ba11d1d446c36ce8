"""Quality classification by a factorisation machine.

A text becomes hashed words (relative frequencies) and bucketed structure statistics. The machine adds a linear
term and low-rank pairwise interactions, scored in linear time by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted on `sample` labelled documents at most (those of the smallest hash), in one task: sample and model
are bounded by parameters, whatever the corpus. The model, 2^bits x (rank + 1) floats, is broadcast; scoring is
one pass over whole texts without a shuffle.

Defined results: a null text is an empty one and gets a score; labels that contradict each other are averaged
(a tie counts as good); labels without a document and documents without a label take no part in the fit;
without any labels the score is 0.5; repeated rows get the same score; clashing columns do no harm,
since the row travels as one struct.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize

BITS, RANK, SAMPLE, EPOCHS = 14, 8, 12_000, 6
BUCKETS, STATISTICS = 24, 12
WORDS = re.compile(r"\S+")


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure of a text, each value scaled to about 0 to 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    letters = sum(map(str.isalpha, text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    lines = text.split("\n")
    odd = len(re.findall(r"[^\w\s.,;:'\"()-]", text))
    ends = Counter(w[-1] for w in words)
    return [
        np.log1p(n) / 12,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        upper / max(1, letters),
        odd / chars * 4,
        letters / chars,
        len(re.findall(r"[0-9]", text)) / chars * 4,
        min(1.0, chars / n / 16),
        1 - len(set(lines)) / len(lines),
        sum(1 for w in words if len(w) == 1) / n * 2,
        (ends["."] + ends["!"] + ends["?"]) / n * 2,
        min(1.0, n / len(lines) / 200),
    ]


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values. The first STATISTICS x BUCKETS indexes are for statistics, the rest for words."""
    text = text or ""
    words = WORDS.findall(text)
    counts = Counter(words)
    first, room = STATISTICS * BUCKETS, (1 << bits) - STATISTICS * BUCKETS
    stats = np.clip(np.array(statistics(text, words, counts)), 0, 1)
    index = [np.arange(STATISTICS) * BUCKETS + np.minimum(BUCKETS - 1, (stats * BUCKETS).astype(int))]
    value = [np.full(STATISTICS, 0.5)]
    if counts:
        h = np.fromiter((xxhash.xxh32_intdigest(w) for w in counts), np.int64, len(counts)) % room + first
        x = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        index.append(h)
        value.append(x / np.sqrt(np.square(x).sum()))
    return np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)


def margin(w0: float, w: np.ndarray, v: np.ndarray, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output for rows that begin at `starts`, and the rows' factor sums."""
    xv = v[index] * value[:, None]
    sums = np.add.reduceat(xv, starts, axis=0)
    pairs = 0.5 * (np.square(sums) - np.add.reduceat(np.square(xv), starts, axis=0)).sum(1)
    return w0 + np.add.reduceat(w[index] * value, starts) + pairs, sums


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, rank: int, epochs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the logistic loss with a little weight decay; a fixed seed, so that reruns agree."""
    rng = np.random.default_rng(8)
    size = 1 << bits
    w0, w, v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank))
    g0, gw, gv = 1.0, np.full(size, 1e-2), np.full((size, rank), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = [rows[i] for i in order[at : at + 128]]
            index, value = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch]).astype(np.float64)
            lengths = np.array([len(b[0]) for b in batch])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            out, sums = margin(w0, w, v, index, value, starts)
            error = (1 / (1 + np.exp(-out)) - labels[order[at : at + 128]]) / len(batch)
            each = np.repeat(error, lengths)
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, each * value) + 1e-6 * w[used]
            push = (each * value)[:, None] * (np.repeat(sums, lengths, axis=0) - v[index] * value[:, None])
            dv = np.stack([np.bincount(back, push[:, f]) for f in range(rank)], 1) + 1e-6 * v[used]
            g0 += error.sum() ** 2
            w0 -= 0.3 * error.sum() / np.sqrt(g0)
            gw[used] += np.square(dw)
            w[used] -= 0.3 * dw / np.sqrt(gw[used])
            gv[used] += np.square(dv)
            v[used] -= 0.05 * dv / np.sqrt(gv[used])
    return w0, w, v


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, rank: int = RANK, epochs: int = EPOCHS) -> bytes | None:
    """The fitted machine, from labels outside the held-out quarter."""
    kept = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    )
    kept = kept.orderBy(F.xxhash64(F.lit(8), "labelled"), "labelled").limit(sample)
    texts = docs.select("doc_id", "text").join(kept, F.col("doc_id") == F.col("labelled")).select("labelled", "good", "text").dropDuplicates(["labelled"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [features(t, bits) for t in pdf["text"]]
            yield pd.DataFrame({"labelled": pdf["labelled"], "good": pdf["good"], "index": [i.tobytes() for i, _ in made], "value": [x.tobytes() for _, x in made]})

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"labelled": [], "good": [], "index": [], "value": []})]).sort_values("labelled")
        if len(all_rows):
            made = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(all_rows["index"], all_rows["value"], strict=True)]
            w0, w, v = fit(made, all_rows["good"].to_numpy(float), bits, rank, epochs)
            yield pd.DataFrame({"model": [np.concatenate([[w0], w, v.ravel()]).astype(np.float32).tobytes()]})

    vectors = materialize(texts.mapInPandas(rows, "labelled long, good int, index binary, value binary"), "quality-sample")
    model = vectors.repartition(1).mapInPandas(one, "model binary").collect()
    return bytes(model[0]["model"]) if model else None


def score(docs: DataFrame, model: bytes | None, bits: int = BITS, rank: int = RANK) -> DataFrame:
    """row (the input's) and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if held.value is None:
            for t in texts:
                yield pd.Series(np.full(len(t), 0.5))
            return
        flat = np.frombuffer(held.value, np.float32)
        size = 1 << bits
        w0, w, v = flat[0], flat[1 : 1 + size], flat[1 + size :].reshape(size, rank)
        for t in texts:
            out = []
            for text in t:
                index, value = features(text, bits)
                out.append(margin(w0, w, v, index, value, np.array([0]))[0][0])
            yield pd.Series(1 / (1 + np.exp(-np.array(out, np.float64))))

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scored(F.col("text")).alias("score"))
