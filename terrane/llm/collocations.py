"""Collocations by suffix sorting with one stack.

Texts are cut into pieces at punctuation and line ends. Every word of a piece starts a suffix, truncated at `longest`
words. Tasks count equal suffixes and pack them, sorted, into one row for each part of the shuffle, so that few and
well-compressing rows travel. The shuffle is by language and first word; suffixes of a frequent first word are dealt out
by the words after it too: by the shortest beginning that is not frequent, so that no task gets more than a small share
of all. Each task sorts its suffixes in reverse order and counts all their prefixes with one stack: a count is complete
when a suffix comes that does not start with the prefix. Only the frequent beginnings go on in other tasks; they are
given out whatever their count, and sums over tasks make them whole. Counts of a phrase's parts are joined afterwards.
Which beginnings are frequent is taken from a sample of the texts; it decides where suffixes go, not what is counted.

A task holds about the suffixes of `partition_bytes` of text, so the number of parts grows with the texts.

Defined results: a null text is an empty one; a null language is `und`, as is the language of that name; repeated rows
count as often as they stand there; phrases do not span pieces; columns other than text and lang are not read; an empty
table, or none with a frequent phrase, gives no rows. Scores are exact: the arithmetic is in decimals of 38 digits,
enough for counts up to 10^15.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import materialize

#: Lower case for A-Z, a line end for what ends a piece, a space for a tab.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Suffixes that a task counts before it gives them out.
HELD = 300_000


def truncated_suffixes(text: bytes, longest: int) -> list[bytes]:
    """The suffixes of a text's pieces, at most `longest` words each; a space ends every word."""
    out = []
    for piece in text.translate(FOLD).split(b"\n"):
        words = piece.split()
        if words:
            line = b" ".join([*words, b""])
            ends = list(accumulate(map(len, words), lambda a, n: a + n + 1, initial=0))
            last = len(words)
            out += [line[ends[i] : ends[i + longest if i + longest < last else last]] for i in range(last)]
    return out


def dealt(suffixes: Iterable[bytes], lang: str, parts: int, frequent: frozenset[bytes]) -> dict[int, list[bytes]]:
    """Suffixes by part: a hash of their shortest beginning, of whole words, that is not frequent."""
    seed, out, of_first = zlib.crc32(lang.encode("utf-8", "surrogatepass")), {}, {}
    for suffix in suffixes:
        end = suffix.index(b" ") + 1
        begin = suffix[:end]
        held = of_first.get(begin)
        if held is None:
            if begin in frequent:
                while end < len(suffix) and begin in frequent:
                    end = suffix.index(b" ", end) + 1
                    begin = suffix[:end]
                out.setdefault(zlib.crc32(begin, seed) % parts, []).append(suffix)
                continue
            held = of_first[begin] = out.setdefault(zlib.crc32(begin, seed) % parts, [])
        held.append(suffix)
    return out


def prefix_counts(rows: Mapping[bytes, int], least: int, frequent: frozenset[bytes]) -> list[tuple[bytes, int]]:
    """Counts of suffixes -> those of their prefixes, of all that occur at least `least` times and of the frequent beginnings.

    The stack holds a count for each prefix of the last suffix, without what is above it; the first `hot` of them are
    frequent beginnings, whose own beginnings are frequent too.
    """
    out: list[tuple[bytes, int]] = []
    last, counts, hot = [b""], [], 0
    for suffix in [*sorted(rows, reverse=True), None]:
        words = suffix.split(b" ") if suffix is not None else [b"", b""]  # an empty word ends them
        common = 0
        while words[common] == last[common] != b"":
            common += 1
        for k in range(len(counts), common, -1):
            n = counts.pop()
            if k > 1:
                counts[-1] += n
            if n >= least or k <= hot:
                out.append((b" ".join(last[:k]), n))
        if suffix is None:
            break
        counts += [0] * (len(words) - 1 - common)
        counts[-1] += rows[suffix]
        last = words
        if common <= hot:
            hot = common
            while hot < len(counts) and b" ".join([*words[: hot + 1], b""]) in frequent:
                hot += 1
    return out


def worth_sorting(runs: Sequence[tuple[list[bytes], list[int]]], least: int, frequent: frozenset[bytes]) -> dict[bytes, int]:
    """Counts of suffixes, those that begin with two words of too small a count cut to their first word: no longer prefix of theirs can count."""
    heads: dict[bytes, int] = {}
    seen = heads.get
    cut = [[s[: s.find(b" ", s.find(b" ") + 1) + 1] or s for s in names] for names, _ in runs]
    for own, (_, counts) in zip(cut, runs, strict=True):
        for head, n in zip(own, counts, strict=True):
            heads[head] = seen(head, 0) + n
    kept = {head for head, n in heads.items() if n >= least} | {head for head in heads if head in frequent}
    out: dict[bytes, int] = {}
    for own, (names, counts) in zip(cut, runs, strict=True):
        for head, suffix, n in zip(own, names, counts, strict=True):
            if head in kept:
                out[suffix] = out.get(suffix, 0) + n
    for head, n in heads.items():
        if head not in kept:
            first = head[: head.index(b" ") + 1]
            out[first] = out.get(first, 0) + n
    return out


def _counted(texts: DataFrame, longest: int, told, schema: str) -> DataFrame:
    """What `told` makes of the suffixes that tasks have counted, by language; at most HELD of them at a time."""
    most = HELD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(truncated_suffixes(text.as_py(), longest))
                if sum(map(len, held.values())) > most:
                    yield told(held)
                    held = {}
        yield told(held)

    wanted = texts.filter(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return wanted.mapInArrow(count, schema)


def suffixes(docs: DataFrame, longest: int) -> DataFrame:
    """lang, suffix, n: truncated suffixes, counted within tasks."""

    def told(held: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in held.items() for _ in range(len(c))]
        names, counts = [s for c in held.values() for s in c], [n for c in held.values() for n in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "suffix", "n"])

    return _counted(docs, longest, told, "lang string, suffix string, n long")


def packed(docs: DataFrame, longest: int, parts: int, frequent: dict[str, frozenset[bytes]]) -> DataFrame:
    """part, lang, names, counts: suffixes counted within tasks, as sorted lines and as longs."""

    def told(held: dict[str, Counter]) -> pa.RecordBatch:
        rows = []
        for lang, counter in held.items():
            for part, names in dealt(counter, lang, parts, frequent.get(lang, frozenset())).items():
                names.sort()
                rows.append((part, lang, b"\n".join(names), np.fromiter(map(counter.__getitem__, names), np.int64, len(names)).tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["part", "lang", "names", "counts"])

    return _counted(docs, longest, told, "part int, lang string, names binary, counts binary")


def frequent_beginnings(docs: DataFrame, total: int, longest: int, share: float, sample_bytes: int) -> dict[str, frozenset[bytes]]:
    """By language the beginnings that more than a share of a sample's suffixes have: at most longest / share of them. total: bytes of all texts."""
    sampled = suffixes(docs.filter(F.rand(13) < sample_bytes / max(1, total)), longest)
    words = F.split(F.rtrim("suffix"), " ")
    begins = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    counted = materialize(sampled.select("lang", "n", F.explode(begins).alias("begin")).groupBy("lang", "begin").agg(F.sum("n").alias("n")), "collocations-sample")
    one = F.size(F.split("begin", " ")) == 1
    suffixes_seen = counted.filter(one).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found: dict[str, set[bytes]] = {}
    for r in counted.filter(F.col("n") > share * suffixes_seen).collect():
        found.setdefault(r["lang"], set()).add(r["begin"].encode() + b" ")
    return {lang: frozenset(s) for lang, s in found.items()}


def frequent_phrases(rows: DataFrame, least: int, parts: int, frequent: dict[str, frozenset[bytes]]) -> DataFrame:
    """lang, phrase, f: all phrases that occur at least `least` times, from packed suffixes; and the number of all words, as phrase ''."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[list[bytes], list[int]]]] = {}
        for batch in batches:
            for lang, names, counts in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                held.setdefault(lang, []).append((names.split(b"\n"), np.frombuffer(counts, np.int64).tolist()))
        for lang, runs in held.items():
            known = frequent.get(lang, frozenset())
            out = [(b"", sum(sum(counts) for _, counts in runs)), *prefix_counts(worth_sorting(runs, least, known), least, known)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array([p for p, _ in out], pa.binary()).cast(pa.string()), pa.array([n for _, n in out], pa.int64())], ["lang", "phrase", "f"])

    swept = rows.repartitionById(parts, F.col("part")).mapInArrow(sweep, "lang string, phrase string, f long")
    return swept.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def _scores(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of each phrase of two words or more, by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    candidates = phrases.select("lang", "phrase", words.alias("words"), F.col("f").alias("a")).filter(F.size("words") >= 2)
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    of = lambda at, name: phrases.select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), F.col("f").alias(name)).withColumnsRenamed({"part_lang": f"lang_{name}", "part": at})
    joined = cuts.join(of("first_part", "l"), (F.col("lang") == F.col("lang_l")) & (F.col("first") == F.col("first_part")))
    joined = joined.join(of("rest_part", "r"), (F.col("lang") == F.col("lang_r")) & (F.col("rest") == F.col("rest_part")))
    joined = joined.join(totals.withColumnRenamed("lang", "lang_n"), F.col("lang") == F.col("lang_n"))
    exact = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {exact('a')} * {exact('n')}) DIV ({exact('l')} * {exact('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return joined.groupBy("lang", "phrase", "words", "a", "n").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def _within_longer(candidates: DataFrame) -> DataFrame:
    """lang, inner, most: of each phrase within a longer candidate, the longer one's largest count."""
    size = F.size("words")
    starts = lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), starts))
    return candidates.filter(size >= 3).select("lang", F.explode(inner).alias("inner"), "a").groupBy("lang", "inner").agg(F.max("a").alias("most"))


def mine(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, buckets: int = 64, sample_bytes: int = 16 << 20, partition_bytes: int = 4 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur at least `least` times.

    `partition_bytes` of text are meant for one task; a sample of `sample_bytes` tells the beginnings with more than a
    quarter of that (and more than 1 in 100,000 of all, so that their set is bounded). A phrase goes where a longer one holds it and is as frequent. Ranks are dealt in two steps, so that no task
    sorts all phrases of a language.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, total // partition_bytes + 1)
    frequent = frequent_beginnings(docs, total, longest, max(0.25 / parts, 1e-5), sample_bytes)
    swept = materialize(frequent_phrases(packed(docs, longest, parts, frequent), least, parts, frequent), "collocations-phrases")
    totals, phrases = swept.filter("phrase = ''").select("lang", F.col("f").alias("n")), swept.filter("phrase <> ''")
    scored = _scores(phrases, totals)
    longer = _within_longer(scored).select(F.col("lang").alias("longer_lang"), "inner", "most")
    kept = scored.join(longer, (F.col("lang") == F.col("longer_lang")) & (F.col("phrase") == F.col("inner")), "left").filter(F.coalesce(F.col("most") < F.col("a"), F.lit(True)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = kept.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
