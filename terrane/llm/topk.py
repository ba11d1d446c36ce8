"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of the inner products of `slices` slices of the dimensions; a query's local scores in a slice are a
list. Rows are packed into rows of about PACKED bytes, which are dealt to blocks of candidates. A block's task holds its
candidates as one matrix and reads the packed queries one after the other; queries go to every block once a phase, candidates to
their own block only.

1. Each block finds the k best entries of each query's local list in each slice; these few are summed exactly. The
   k-th best of them over all blocks is a cutoff that no answer can be under.
2. The cutoff goes back to the queries. A candidate that reaches it must reach cutoff / slices in one slice at least,
   so each block collects the entries at or above that uniform threshold. A query does not look at a slice of a block
   where the product of its norm and the block's largest norm stays under the threshold.
3. The scores of what was collected are resolved exactly; those at or above the cutoff are returned and ranked.

Cutoffs travel with the packed queries (their number grows with the queries, so no broadcast holds them).

Defined results: rows whose vec_id or vector is null, or whose vector holds null or non-finite components, take no
part; vectors of other lengths count as padded with zeros; candidate rows that repeat each count; query rows of one
vec_id count as their smallest vector; candidates with the query's vec_id are its own; ties go to the smaller
vec_id; scores are exact integers, and one beyond 63 bits counts as the nearest long. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import materialize

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Bytes of a packed row's vectors and of a block's, both as 8 bytes a component; products that a task holds at once.
PACKED, BLOCK_BYTES, PRODUCTS = 1 << 16, 1 << 25, 1 << 18


def whole(vector: Column, scale: int = 256) -> Column:
    """The floors of the scaled components, as doubles (from 2^53 on a double is its own floor); what overflows is the largest double."""
    scaled = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(1.7e308)), F.lit(-1.7e308))
    return F.transform(F.transform(vector, scaled), lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))


def usable(frame: DataFrame, vector: str) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    infinite = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))
    return frame.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).filter(fine)


def _packed(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (vec_id, vector and some longs) as rows of bytes; vectors of short integers where all are."""
    schema = "nth long, n int, code string, width int, ids binary, vectors binary" + "".join(f", {c} binary" for c in more)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nth = TaskContext.get().partitionId() << 33
        for b in batches:
            out, at = [], 0
            widths = b["vector"].map(len).to_numpy()
            while at < len(b):
                width = max(1, widths[at : at + PACKED // 8].max())
                part = b.iloc[at : at + max(1, PACKED // (8 * width))]
                given = [np.asarray(v) for v in part["vector"]]
                m = np.zeros((len(part), width), np.int64 if all(v.dtype.kind == "i" for v in given) else np.float64)
                for row, v in zip(m, given, strict=True):
                    row[: len(v)] = v
                short = not m.size or (m.min() >= -(1 << 15) and m.max() < 1 << 15)
                m = m.astype(np.int16) if short else m
                out.append((nth, len(part), m.dtype.str, width, part["vec_id"].to_numpy(np.int64).tobytes(), m.tobytes(), *[part[c].to_numpy(np.int64).tobytes() for c in more]))
                nth, at = nth + 1, at + len(part)
            yield pd.DataFrame(out, columns=["nth", "n", "code", "width", "ids", "vectors", *more])

    return rows.select("vec_id", "vector", *more).mapInPandas(pack, schema)


class _Rows:
    """Packed rows as one matrix of longs where all fit, else of Python's integers."""

    def __init__(self, packed: list) -> None:
        self.ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in packed])
        given = [np.frombuffer(r.vectors, r.code).reshape(r.n, r.width) for r in packed]
        small = all(not v.size or np.abs(v.astype(np.float64)).max() < 2.0**62 for v in given)
        self.v = np.zeros((len(self.ids), max(v.shape[1] for v in given)), np.int64 if small else object)
        at = 0
        for v in given:
            self.v[at : at + len(v), : v.shape[1]] = v.astype(np.int64) if small else [[int(x) for x in row] for row in v.tolist()]
            at += len(v)
        self.largest, self.cast, self.order = _largest(self.v), {}, np.argsort(self.ids, kind="stable")
        self.sorted = self.ids[self.order]

    def widened(self, width: int) -> None:
        if width > self.v.shape[1]:
            self.v, self.cast = np.pad(self.v, ((0, 0), (0, width - self.v.shape[1]))), {}

    def part(self, a: int, b: int, kind: type) -> np.ndarray:
        if (a, b, kind) not in self.cast:
            self.cast[a, b, kind] = np.ascontiguousarray(self.v[:, a:b].astype(kind))
        return self.cast[a, b, kind]

    def norms(self, a: int, b: int) -> np.ndarray:
        if (a, b) not in self.cast:
            self.cast[a, b] = _norms(self.v[:, a:b])
        return self.cast[a, b]

    def same(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of equal ids: in asked, and here."""
        lo, hi = np.searchsorted(self.sorted, asked, "left"), np.searchsorted(self.sorted, asked, "right")
        i = np.repeat(np.arange(len(asked)), hi - lo)
        return i, self.order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[i]]


def _largest(a: np.ndarray) -> float:
    return float(np.abs(a).max()) if a.size else 0.0


def _products(q: _Rows, x: _Rows, slices: int) -> tuple[list[tuple[int, int]], type, Callable[[int, int, int, int], np.ndarray]]:
    """The slices, the type of their products, and the products of the queries lo to hi with all rows of x: in floats, doubles or longs where they hold every sum exactly."""
    width = max(q.v.shape[1], x.v.shape[1])
    q.widened(width)
    x.widened(width)
    cuts = np.unique(np.linspace(0, width, slices + 1).astype(int)).tolist()
    bound = q.largest * x.largest * max(1, width)
    kind = np.float32 if bound < 2.0**23 else np.float64 if bound < 2.0**52 else np.int64 if bound < 2.0**62 else object
    return list(zip(cuts[:-1], cuts[1:], strict=True)), kind, lambda lo, hi, a, b: q.part(a, b, kind)[lo:hi] @ x.part(a, b, kind).T


def _best(local: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k largest of each row (all, if fewer)."""
    m, n = local.shape
    if n <= k:
        return np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
    if local.dtype != object and n >= 32 * k:
        of = local[:, : n // 16 * 16].reshape(m, 16, -1).max(1)  # no row's k-th largest is under the k-th largest of these
        reach = local >= np.partition(of, of.shape[1] - k, axis=1)[:, -k, None]
        at = np.flatnonzero(reach)
        if len(at) <= 16 * k * m:
            at = at[np.lexsort((-local.ravel()[at], at // n))]
            i, j = np.divmod(at, n)
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            return i[first], j[first]
    return np.repeat(np.arange(m), k), np.argpartition(local, n - k, axis=1)[:, -k:].ravel()


def _summed(q: _Rows, c: _Rows, i: np.ndarray, j: np.ndarray, pairs: int = 1 << 16) -> np.ndarray:
    """Inner products of the rows i of q and j of c, pair by pair, as longs; some pairs at a time."""
    y, x, fits, out = q.v, c.v, q.largest * c.largest * max(1, q.v.shape[1]) < 2.0**62, np.empty(len(i), np.int64)
    for at in range(0, len(i), pairs):
        a, b = y[i[at : at + pairs]], x[j[at : at + pairs]]
        if fits:
            out[at : at + pairs] = np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
        else:
            exact = (a.astype(object) * b.astype(object)).sum(1)
            out[at : at + pairs] = [min(max(int(v), LEAST), MOST) for v in exact]
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.square(a.astype(np.float64)).sum(1))


def _first(asked: _Rows, cutoff: np.ndarray, x: _Rows, k: int, slices: int) -> Iterator[pd.DataFrame]:
    parts, kind, product = _products(asked, x, slices)
    step = max(1, PRODUCTS // len(x.ids))
    for lo in range(0, len(asked.ids), step):
        hi, found = min(lo + step, len(asked.ids)), []
        own = x.same(asked.ids[lo:hi])
        for a, b in parts:
            local = product(lo, hi, a, b)
            local[own] = -(10**700) if kind is object else LEAST if kind is np.int64 else -np.inf
            i, j = _best(local, k)
            found.append(i * len(x.ids) + j)
        i, j = np.divmod(np.setdiff1d(np.concatenate(found), own[0] * len(x.ids) + own[1]), len(x.ids))
        score = _summed(asked, x, i + lo, j)
        order = np.lexsort((-np.maximum(score, LEAST + 1), i))  # of a block, no more than k scores can be among a query's k best
        i, score = i[order], score[order]
        yield pd.DataFrame({"query_id": asked.ids[lo:hi][i], "score": score})[np.arange(len(i)) - np.searchsorted(i, i) < k]


def _rest(asked: _Rows, cutoff: np.ndarray, x: _Rows, k: int, slices: int) -> Iterator[pd.DataFrame]:
    parts, kind, product = _products(asked, x, slices)
    step = max(1, PRODUCTS // len(x.ids))
    uniform, every = cutoff // len(parts), cutoff == LEAST  # rounded down: a sum that reaches the cutoff has a part that reaches this
    with np.errstate(invalid="ignore"):  # a slice is left out for the queries that no row of it can bring to the threshold, but not where a norm overflows
        seen = [every | ~(asked.norms(a, b) * x.norms(a, b).max() * (1 + 1e-9) + 1 < uniform) for a, b in parts]
    for lo in range(0, len(asked.ids), step):
        hi, total = min(lo + step, len(asked.ids)), None
        if not any(s[lo:hi].any() for s in seen):
            continue
        collected = np.tile(every[lo:hi, None], (1, len(x.ids)))
        # Rounded down to a float, a threshold collects no less.
        least, lowest = (np.nextafter(c[lo:hi].astype(kind), kind(-np.inf))[:, None] if kind in (np.float32, np.float64) else c[lo:hi, None] for c in (uniform, cutoff))
        for (a, b), s in zip(parts, seen, strict=True):
            local = product(lo, hi, a, b)
            collected |= (local >= least).astype(bool) & s[lo:hi, None]
            total = local if total is None else total + local
        collected[x.same(asked.ids[lo:hi])] = False
        if kind is not object:
            collected &= total >= lowest
        at = np.flatnonzero(collected)
        (i, j), score = np.divmod(at, len(x.ids)), total.ravel()[at]
        score = np.array([min(max(int(v), LEAST), MOST) for v in score], np.int64) if kind is object else score.astype(np.int64)
        held = score >= cutoff[lo:hi][i]
        i, j, score = i[held], j[held], score[held]
        order = np.lexsort((x.ids[j], -np.maximum(score, LEAST + 1), i))  # of a block, no more than k entries of a query can be answers
        i, j, score = i[order], j[order], score[order]
        yield pd.DataFrame({"query_id": asked.ids[lo:hi][i], "vec_id": x.ids[j], "score": score})[np.arange(len(i)) - np.searchsorted(i, i) < k]


def top_k(frame: DataFrame, queries: DataFrame, k: int = 5, slices: int = 4, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have vec_id and vector (array of long, or of doubles without fractions).

    A block has about block_rows rows; more, as far as BLOCK_BYTES go, where there would be more blocks than shuffle partitions.
    """
    said = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)).alias("components")).first()
    most = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(1, -(-8 * said["components"] // BLOCK_BYTES), min(most, -(-said["n"] // block_rows)))
    candidates = materialize(_packed(frame), "topk-rows").withColumn("block", F.pmod(F.xxhash64("nth"), F.lit(n_blocks)).cast("int")).drop("nth")
    wanted = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))

    def meet(asked: DataFrame, phase: Callable[..., Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """Each packed row of queries goes to each block, behind the block's candidates."""
        sent = _packed(asked, "cutoff").drop("nth").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        rows = candidates.withColumn("cutoff", F.lit(None).cast("binary")).withColumn("asks", F.lit(False)).unionByName(sent.withColumn("asks", F.lit(True)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, held, x = None, [], None
            for b in batches:
                for r in b.itertuples(index=False):
                    if r.block != block:
                        block, held, x = r.block, [], None
                    if not r.asks:
                        held.append(r)
                    elif held:
                        x = x or _Rows(held)
                        yield from phase(_Rows([r]), np.frombuffer(r.cutoff, np.int64), x, k, slices)

        return rows.repartition(n_blocks, "block").sortWithinPartitions("block", "asks").mapInPandas(run, schema)

    none = F.lit(LEAST)
    listed = meet(wanted.withColumn("cutoff", none), _first, "query_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    cutoffs = listed.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n"))
    cutoffs = cutoffs.select("query_id", F.when(F.col("n") == k, F.col("cutoff")).alias("cutoff"))
    told = wanted.join(cutoffs, F.col("vec_id") == F.col("query_id"), "left").withColumn("cutoff", F.coalesce("cutoff", none))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = meet(told, _rest, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(ranked))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
