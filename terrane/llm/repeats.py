"""Repeated passages by De Bruijn compaction.

Every window of `window` words is an edge of a De Bruijn graph from its first to its last `window` - 1 words. Windows
that follow each other in a document and share their minimizer (the occurrence of their smallest hashed `seed`-gram)
form one path, named by the hash of its words; equal windows always have equal minimizers at equal offsets, so the
graph falls into buckets by minimizer.

1. Buckets of one row's paths only hold nothing repeated and go (a join on the minimizer).
2. Where a path as a whole also is in a document of smaller id, it does not branch: all its windows are repeated, from
   the source coordinates of the smallest document.
3. Where a bucket branches (several different paths), its other paths are expanded to windows at their coordinates, and
   windows are joined one by one.
4. Paths that follow each other in a document and in their source too are compacted to one long span.
5. The words of each span and those at its source coordinates are read again and compared by 128-bit digests; spans
   whose 64-bit hashes had only collided are dropped. The others go from the documents.

Rows are numbered and bucketed once (one file for a bucket, and no more than `most_buckets`); every later step moves
coordinates to them and no text. A passage in very many documents is one row for each document and path, and what such
rows are joined to is a table, so that adaptive execution splits a hot key's partition.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; a window repeated within
one document, or in rows of the same doc_id, is no repeat; each row is judged by its own text, also where rows repeat
or share a doc_id; a null doc_id is smaller and larger than no other and keeps its words. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import materialize, shared_dir

WINDOW, SEED = 13, 5
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _rolled(h: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of `length` values."""
    n = len(h) - length + 1
    out = h[:n].copy()
    for j in range(1, length):
        out *= BASE
        out += h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def _hashed(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)


def least_of(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of each run of `width` values and where the leftmost such stands, by runs that double."""
    best, where, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        less = best[step:] < best[:-step]
        best, where = np.where(less, best[step:], best[:-step]), np.where(less, where[step:], where[:-step])
        have += step
    return best, where


def paths(texts: list[list[bytes]], window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of documents as words: which document, first window, number of windows, minimizer and hash of each path.

    Documents are hashed one behind the other; windows that reach into the next one are left out.
    """
    texts_at = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    h = _hashed(chain.from_iterable(texts), int(texts_at[-1]))
    if len(h) < window:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    best, where = least_of(_rolled(h, seed), window - seed + 1)
    which = np.repeat(np.arange(len(texts)), np.diff(texts_at))[: len(best)]
    inside = np.flatnonzero(np.arange(window, window + len(best)) <= texts_at[which + 1])
    where = where[inside]
    begin = np.flatnonzero(np.concatenate([[len(where) > 0], where[1:] != where[:-1]])[: len(where)])
    first, count = inside[begin], np.diff(np.append(begin, len(inside)))
    # The hash of words first .. first + count + window - 2, from prefix sums of the polynomial, brought to BASE^0 for the first.
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(len(h))[: len(h)], dtype=np.uint64)])
    names = (prefix[first + count + window - 1] - prefix[first]) * _inverse_powers(len(h))[first]
    names ^= names >> np.uint64(31)
    names = (names + count.astype(np.uint64)) * MIX
    return which[first], first - texts_at[which[first]], count, best[first], names


def in_batches(texts: Iterable[str | None], words: int = 1 << 17) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Texts as words, in lists of about so many words, each with the place of its first text."""
    held, n, at = [], 0, 0
    for text in texts:
        held.append(split_words(text))
        n += len(held[-1])
        if n >= words:
            yield at, held
            held, n, at = [], 0, at + len(held)
    if held:
        yield at, held


_POWERS: dict[str, np.ndarray] = {}
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64; kept between documents of a task."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 15), base, np.uint64)]), dtype=np.uint64)
        _POWERS[name] = have
    return have


def _powers(n: int) -> np.ndarray:
    return _grown("up", BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("down", INVERSE, n)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def repeated(docs: DataFrame, window: int = WINDOW, seed: int = SEED, bucket_bytes: int = 16 << 20, most_buckets: int = 50_000) -> DataFrame:
    """doc_id, text, marks: the rows by the starts (at) and numbers (n) of their repeated windows."""
    spark = docs.sparkSession
    name = f"repeats_{uuid.uuid4().hex}"
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = min(most_buckets, max(8, -(-volume // bucket_bytes)))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).repartition(buckets, "row")
    rows.write.bucketBy(buckets, "row").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    held = spark.table(name)
    named_rows = held.filter("doc_id is not null")

    def seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, texts in in_batches(pdf["text"]):
                which, _, _, least, _ = paths(texts, window, seed)
                order = np.lexsort((least, which))
                which, least = which[order], least[order]
                once = np.concatenate([[True], (which[1:] != which[:-1]) | (least[1:] != least[:-1])])[: len(least)]
                yield pd.DataFrame({"least": _signed(least[once])})

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            doc, row = pdf["doc_id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64)
            for start, texts in in_batches(pdf["text"]):
                which, at, n, least, hashed = paths(texts, window, seed)
                yield pd.DataFrame({"doc": doc[start + which], "row": row[start + which], "at": at.astype(np.int32), "n": n.astype(np.int16), "least": _signed(least), "name": _signed(hashed)})

    # What a join reads beside rows of a key in every document is a table of its own, so that a hot key's partition can be split.
    alone = named_rows.select("text").mapInPandas(seeds, "least long").groupBy("least").agg(F.count("*").alias("rows"))
    shared = materialize(alone.filter("rows > 1").select("least"), "repeats-seeds")
    every = named_rows.mapInPandas(emit, "doc long, row long, at int, n short, least long, name long")
    kept = materialize(every.join(shared, "least"), "repeats-paths")
    place = F.min(F.struct("doc", "row", "at")).alias("source")
    sources = materialize(kept.groupBy("least", "name").agg(place), "repeats-sources")
    branching = materialize(sources.groupBy("least").agg(F.count("*").alias("names")).filter("names > 1").select("least", F.lit(True).alias("branching")), "repeats-branches")
    judged = kept.join(materialize(sources.join(branching, "least", "left"), "repeats-graph"), ["least", "name"])
    judged = judged.withColumn("whole", F.col("source.doc") < F.col("doc")).filter("whole or branching")
    judged = materialize(judged.select("doc", "row", "at", "n", "least", "source", "whole"), "repeats-judged")

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple[np.ndarray, ...]] = []
            for doc, row, text, ats, ns, leasts in zip(pdf["doc_id"], pdf["row"], pdf["text"], pdf["ats"], pdf["ns"], pdf["leasts"], strict=True):
                words, n = split_words(text), ns.astype(np.int64)
                at = np.repeat(ats - np.cumsum(n) + n, n) + np.arange(n.sum())
                out.append((np.full(len(at), doc, np.int64), np.full(len(at), row, np.int64), at, np.repeat(leasts, n), _signed(_rolled(_hashed(words, len(words)), window)[at])))
            if out:
                yield pd.DataFrame({k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("doc", "row", "at", "least", "name"))}).astype({"at": "int32"})

    # Rows keep their buckets; only coordinates are shuffled to them.
    open_at = judged.filter("not whole").groupBy("row").agg(F.collect_list(F.struct("at", "n", "least")).alias("where"))
    windows = materialize(held.join(open_at.hint("shuffle_hash"), "row").select("doc_id", "row", "text", F.col("where.at").alias("ats"), F.col("where.n").alias("ns"), F.col("where.least").alias("leasts")).mapInPandas(expand, "doc long, row long, at int, least long, name long"), "repeats-windows")
    twice = windows.groupBy("least", "name").agg(place, F.max("doc").alias("last")).filter("source.doc < last").drop("last")
    single = windows.join(materialize(twice, "repeats-twice"), ["least", "name"]).filter("source.doc < doc")
    marks = judged.filter("whole").select("row", "at", "n", "source").unionByName(single.select("row", "at", F.lit(1).cast("short").alias("n"), "source"))
    spans = verified(held, materialize(compacted(marks), "repeats-spans"), window)
    found = spans.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("marks"))
    return held.join(found.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "marks")


def compacted(marks: DataFrame) -> DataFrame:
    """row, at, n, source (of paths) -> row, at, n, s_row, s_at: paths that follow each other in a row and in their source are one."""
    flat = marks.select("row", "at", F.col("n").cast("int").alias("n"), F.col("source.row").alias("s_row"), F.col("source.at").alias("s_at")).distinct()
    line = Window.partitionBy("row", "s_row", F.col("at") - F.col("s_at")).orderBy("at")
    begins = F.coalesce(F.lag(F.col("at") + F.col("n")).over(line) < F.col("at"), F.lit(True))
    runs = flat.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(line))
    runs = runs.groupBy("row", "s_row", (F.col("at") - F.col("s_at")).alias("shift"), "run").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"))
    return runs.select("row", "at", "n", "s_row", (F.col("at") - F.col("shift")).alias("s_at"))


def verified(held: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The spans whose words are those at their source coordinates: both sides' words are read again and their 128-bit digests compared."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row, text, ats, ns in zip(pdf["row"], pdf["text"], pdf["ats"], pdf["ns"], strict=True):
                words = split_words(text)
                out += [(row, at, n, xxhash.xxh3_128_digest(b" ".join(words[at : at + n + window - 1]))) for at, n in zip(ats.tolist(), ns.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["row", "at", "n", "words"])

    asked = spans.select("row", "at", "n").unionByName(spans.select(F.col("s_row").alias("row"), F.col("s_at").alias("at"), "n")).distinct()
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("where"))
    said = materialize(held.join(asked.hint("shuffle_hash"), "row").select("row", "text", F.col("where.at").alias("ats"), F.col("where.n").alias("ns")).mapInPandas(read, "row long, at int, n int, words binary"), "repeats-words")
    of_source = said.select(F.col("row").alias("s_row"), F.col("at").alias("s_at"), "n", F.col("words").alias("s_words"))
    return spans.join(said, ["row", "at", "n"]).join(of_source, ["s_row", "s_at", "n"]).filter("words = s_words").select("row", "at", "n")


def covered(n: int, marks, window: int) -> np.ndarray:
    """Which of n words the marked windows cover."""
    edge = np.zeros(n + 1, np.int32)
    for x in marks if marks is not None else ():
        edge[x["at"]] += 1
        edge[x["at"] + x["n"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def kept_words(docs: DataFrame, window: int = WINDOW, seed: int = SEED, texts_too: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space; null unless texts_too) and its sha256."""

    @F.pandas_udf("n_words long, n_removed long, kept string, kept_sha256 string")
    def cut(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, marked in zip(texts, marks, strict=True):
            words = split_words(text)
            gone = covered(len(words), marked, window)
            left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
            rows.append((len(words), int(gone.sum()), left.decode("utf-8", "surrogatepass") if texts_too else None, hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "kept_sha256"])

    return repeated(docs, window, seed).select("doc_id", cut.asNondeterministic()("text", "marks").alias("cut")).select("doc_id", "cut.*")
