"""Language-model scores of a hierarchical Pitman-Yor model.

A restaurant for each context seats the words that follow it; all of them share one parent, the restaurant of words
without context, whose customers are their tables and whose base draws an unknown word (one class) with probability
`unknown` and else a training word. Each previous word is a context of its own, as is the beginning of a text: their number
is that of the different words, and no two are merged. Dishes are dealt by word, the totals of contexts by context to
owners, in a table with what each partition has of them; after a sweep partitions send their tables to the owners, and get
the totals of those contexts back that they ask for.

Seating is sampled by Gibbs sweeps. A sweep takes all customers of a dish out of a restaurant, with their tables and
these tables' customers of the parent, and draws a new number of tables from its law given all others (a blocked move of
the Chinese-restaurant seating, by generalised Stirling numbers). Dishes do so side by side, given the other dishes'
tables of the sweep before: a parallel sampler, which the tests hold against a sequential one that moves single
customers. Tasks exchange only the totals; the tables after a sweep are kept for the next. Draws depend on the sweep's
number and the partition alone. Seating starts at the
square roots of the counts, which is near where sweeps lead; the first `BURN_IN` sweeps are left out; probabilities are
averaged over the `SAMPLES` after them.

Blocks of about `chunk_bytes` of text ask for their own distinct (word, context) pairs, packed by partitions of the
vocabulary, and get one number back for each; no token is shuffled and no vocabulary broadcast. Words are known by
64-bit hashes. In messages contexts are hashes too, but for the most frequent ones: a book of up to `most_contexts` of
these, one for each `context_bytes` of text, has 16-bit names for them. It changes how messages are written and nothing else. A partition of frequent words, asked for by every block, has its requests cut into slices of about
`slice_bytes`: slices count by themselves, their counts are added up 16 at a time, and each answers with a copy of the sum.

Defined results: a null or empty text is one end token; without training documents every word is unknown and N and V
are 0; repeated rows are each scored; a null doc_id is in training (its remainder is null, not 2) and held_out is false;
other columns are kept out. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize, shared_dir

LEAST_CONTEXTS, BURN_IN, SAMPLES, EXACT = 1024, 1, 2, 512
PARTS_OF_OWNER, HELD_WORDS, SPLIT_BYTES, HASHED = 8, 1 << 20, 4 << 20, 1 << 14
START, END = xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different tokens in the order of their hashes, each token's place among these, and how many each text has: words and one end.

    Arrow splits the texts and numbers their different words, so that a word is hashed once however often it occurs. What
    it needs for that goes as soon as it can, and back to the system, since workers live longer than this call.
    """
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    texts = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = texts.flatten()
    texts = texts.dictionary_encode()
    named, number = texts.dictionary.view(pa.large_binary()), texts.indices.to_numpy()
    del texts
    hashes = np.empty(len(named) + 1, np.uint64)
    hashes[-1] = END
    for k in range(0, len(named), HASHED):
        some = named.slice(k, HASHED).to_numpy(zero_copy_only=False)
        hashes[k : k + len(some)] = np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, len(some))
    if (empty := pc.index(named, pa.scalar(b"", named.type)).as_py()) >= 0:  # white space at a text's ends, and empty texts
        none = np.flatnonzero(number == empty)
        lengths -= np.bincount(np.searchsorted(np.cumsum(lengths), none, side="right"), minlength=len(lengths))
        number, hashes[empty] = np.delete(number, none), END
    lengths += 1
    ends = np.zeros(lengths.sum(), bool)
    ends[np.cumsum(lengths) - 1] = True
    which = np.full(len(ends), len(named), np.int32)
    which[~ends] = number
    del named, number
    pa.default_memory_pool().release_unused()
    words, place = np.unique(hashes, return_inverse=True)
    return words, place[which], lengths


def encoded(texts: list[str | None]) -> pa.Array:
    return pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()).view(pa.large_string())


def distinct(values: np.ndarray) -> np.ndarray:
    """np.unique of unsigned numbers by a plain sort, which takes less time than hashing where most of them differ."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def numbered(codes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with its inverse, of numbers from 0 and less than `below`: a plain sort, with places in the lower bits where 64 hold both."""
    bits = len(codes).bit_length()
    if not len(codes) or int(below).bit_length() + bits > 64:
        return np.unique(codes, return_inverse=True)
    keys = codes.astype(np.uint64)
    keys <<= np.uint64(bits)
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    place = (keys & np.uint64((1 << bits) - 1)).view(np.int64)
    keys >>= np.uint64(bits)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    nth, back = np.cumsum(first), np.empty(len(keys), np.int64)
    nth -= 1
    back[place] = nth
    return keys[first].view(np.int64), back


def n_contexts(volume: int, context_bytes: int, most: int) -> int:
    """How many contexts have short names: a power of two of about volume / context_bytes. All others have long ones."""
    return min(most, max(LEAST_CONTEXTS, 1 << (volume // context_bytes).bit_length()))


def number_type(contexts: int) -> type:
    """The numbers that messages hold classes of contexts in."""
    return np.uint16 if contexts <= 1 << 16 else np.uint32


class Book:
    """Every word is a context: the first 65,535 words of the book are 16-bit numbers, any other word is its hash."""

    LONG = (1 << 16) - 1

    def __init__(self, words: np.ndarray) -> None:
        self.words = words[: self.LONG].astype(np.uint64)
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]

    def short(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(contexts), self.LONG, np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, contexts), len(self.sorted) - 1)
        return np.where(self.sorted[at] == contexts, self.order[at], self.LONG).astype(np.uint16)

    def pack(self, contexts: np.ndarray, short: np.ndarray | None = None) -> bytes:
        short = self.short(contexts) if short is None else short
        return short.tobytes() + contexts[short == self.LONG].tobytes()

    def split(self, data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Short names of n contexts, the hashes of those that have none, and where they end."""
        short, at = np.frombuffer(data, np.uint16, n, at), at + 2 * n
        long = np.frombuffer(data, np.uint64, int((short == self.LONG).sum()), at)
        return short, long, at + long.nbytes

    def unpack(self, data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
        """n contexts, and where they end."""
        short, hashes, at = self.split(data, n, at)
        out, long = np.empty(n, np.uint64), short == self.LONG
        out[~long] = self.words[short[~long]]
        out[long] = hashes
        return out, at

    def names(self, short: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
        """The different contexts among short names and hashes, in order."""
        used = np.flatnonzero(np.bincount(short, minlength=self.LONG + 1)[: self.LONG])
        return distinct(np.concatenate([self.words[used], *hashes]))


class Split:
    """Reads contexts as their short names and the hashes of those that have none."""

    def __init__(self, book: Book) -> None:
        self.book = book

    def unpack(self, data: bytes, n: int, at: int = 0) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        short, hashes, at = self.book.split(data, n, at)
        return (short, hashes), at


class Places:
    """Places of contexts among names in order; a short name's place is looked up once."""

    def __init__(self, names: np.ndarray, book: Book) -> None:
        self.names, self.book, self.of_short = names, book, np.zeros(Book.LONG + 1, np.int64)
        self.of_short[book.order] = np.searchsorted(names, book.sorted)

    def find(self, short: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = self.of_short[short]
        out[short == Book.LONG] = np.searchsorted(self.names, hashes)
        return out

    def unpack(self, data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
        short, hashes, at = self.book.split(data, n, at)
        return self.find(short, hashes), at


def frequent(docs: DataFrame, volume: int, context_bytes: int, most: int) -> Book:
    """Words with short names, roughly the most frequent ones: a task forgets rare words when it holds very many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0

        def merge() -> None:
            nonlocal words, counts, n
            both, which = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(which, np.concatenate(counts), len(both)).astype(np.int64)
            kept = np.sort(np.argsort(-total, kind="stable")[:HELD_WORDS])
            words, counts, n = [both[kept]], [total[kept]], 0

        for batch in batches:  # texts of about `SPLIT_BYTES` at a time are split
            texts = batch.column(0).cast(pa.large_string())
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SPLIT_BYTES
            edges = np.flatnonzero(np.concatenate([[True], upto[1:] != upto[:-1], [True]])) if len(texts) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                new, which, _ = tokenized(texts.slice(a, b - a))
                words.append(new)
                counts.append(np.bincount(which, minlength=len(new)))
                n += len(new)
                if n >= 2 * HELD_WORDS:
                    merge()
        merge()
        words, counts = words[0], counts[0]
        top = np.argsort(-counts, kind="stable")[:wanted]
        yield pa.RecordBatch.from_pydict({"word": words[top].astype(np.int64), "n": counts[top]})

    wanted = min(n_contexts(volume, context_bytes, most), Book.LONG)
    found = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Book(found.orderBy(F.desc("n"), "word").limit(wanted).toPandas()["word"].to_numpy(np.int64).astype(np.uint64))


def pack_contexts(values: np.ndarray, contexts: int | Book) -> bytes:
    return values.astype(number_type(contexts)).tobytes() if isinstance(contexts, int) else contexts.pack(values)


def unpack_contexts(data: bytes, n: int, at: int, contexts: int | Book | Places) -> tuple[np.ndarray, int]:
    if not isinstance(contexts, int):
        return contexts.unpack(data, n, at)
    out = np.frombuffer(data, number_type(contexts), n, at)
    return out, at + out.nbytes


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0: a byte each, 255 where one follows behind them all; then how many follow, and their bytes."""
    large = numbers[numbers >= 255]
    width = 4 if not len(large) or int(large.max()) < 1 << 32 else 8
    return b"".join([np.minimum(numbers, 255).astype(np.uint8).tobytes(), large.astype(f"u{width}").tobytes(), np.uint32(len(large)).tobytes(), bytes([width])])


def narrowed(data: bytes) -> int:
    """The bytes at the end of what `narrow` has written that are not one for each number."""
    return data[-1] * int.from_bytes(data[-5:-1], "little") + 5


def widen(data: bytes, at: int = 0) -> np.ndarray:
    end = len(data) - narrowed(data)
    out = np.frombuffer(data, np.uint8, end - at, at).astype(np.int64)
    out[out == 255] = np.frombuffer(data[end:-5], f"u{data[-1]}")
    return out


class Chunk:
    """Distinct words and (word, context) pairs of a block, ordered by the words' partition.

    contexts: a book, by which every previous word is a context; or a number of classes of previous words.
    """

    def __init__(self, texts: list[str | None], parts: int, contexts: int | Book) -> None:
        self.contexts = contexts
        words, which, self.lengths = tokenized(encoded(texts))
        self.names, context = np.append(words, np.uint64(START)), np.empty_like(which)
        context[1:] = which[:-1]
        context[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = len(words)
        if isinstance(contexts, int):
            self.names, of_class = np.unique(self.names % np.uint64(contexts), return_inverse=True)
            context = of_class[context]
        part = ((words >> np.uint64(10)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.part, self.word_of = words[order], part[order], place[which]
        self.pairs, self.pair_of = numbered(self.word_of * len(self.names) + context, len(words) * len(self.names))

    def requests(self, trained: np.ndarray) -> Iterator[tuple[int, bytes]]:
        counts = np.bincount(self.pair_of, np.repeat(trained, self.lengths).astype(np.float64), len(self.pairs)).astype(np.int64)
        word, context = self.pairs // len(self.names), self.names[self.pairs % len(self.names)]
        per_word = np.bincount(word, minlength=len(self.words)).astype(np.uint32)
        edges = np.flatnonzero(np.concatenate([[True], self.part[1:] != self.part[:-1], [True]]))
        pair_edges = np.searchsorted(word, edges)
        short = None if isinstance(self.contexts, int) else self.contexts.short(self.names)[self.pairs % len(self.names)]
        for a, b, x, y in zip(edges[:-1], edges[1:], pair_edges[:-1], pair_edges[1:], strict=True):
            held = pack_contexts(context[x:y], self.contexts) if short is None else self.contexts.pack(context[x:y], short[x:y])
            yield int(self.part[a]), b"".join([np.array([b - a, y - x], np.int64).tobytes(), self.words[a:b].tobytes(), per_word[a:b].tobytes(), held, narrow(counts[x:y])])


def unpack(data: bytes, contexts: int | Book | Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, pairs of each word, contexts (or their places), counts."""
    n, m = (int(x) for x in np.frombuffer(data, np.int64, 2))
    at = 16
    words = np.frombuffer(data, np.uint64, n, at)
    per_word = np.frombuffer(data, np.uint32, n, at := at + 8 * n)
    context, at = unpack_contexts(data, m, at + 4 * n, contexts)
    counts = widen(data, at) if len(data) > at else np.zeros(m, np.int64)
    return words, per_word, context, counts


def without_counts(data: bytes) -> bytes:
    """A request after its counts have been gathered."""
    return data[: len(data) - narrowed(data) - int(np.frombuffer(data, np.int64, 2)[1])]


def gathered(rows: list[bytes], contexts: int | Book) -> bytes:
    """The training counts of a partition's words and pairs, over all blocks."""
    return gathered_with_rest(rows, [], contexts)[0]


def gathered_with_rest(rows: list[bytes], rests: list[bytes], contexts: int | Book) -> tuple[bytes, bytes]:
    """The training counts, and the contexts that blocks ask for and no pair in training has (8 bytes each; also of `rests`)."""
    by_book = not isinstance(contexts, int)
    parts = [unpack(r, Split(contexts) if by_book else contexts) for r in rows]
    words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    if by_book:
        short, hashes = (np.concatenate([p[2][k] for p in parts]) for k in (0, 1))
        names = contexts.names(short, hashes)
        context = Places(names, contexts).find(short, hashes)
    else:
        names, context = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    most = max(1, len(names))
    code, counts = np.repeat(which, np.concatenate([p[1] for p in parts])) * most + context, np.concatenate([p[3] for p in parts])
    pairs, back = numbered(code[counts > 0], len(words) * most)
    total = np.bincount(back, counts[counts > 0], len(pairs)).astype(np.int64)
    per_word, context = np.bincount(pairs // most, minlength=len(words)), pairs % most
    held, used = np.flatnonzero(per_word), np.bincount(context, minlength=len(names)) > 0
    packed = contexts.pack(names[context], contexts.short(names)[context]) if by_book else pack_contexts(names[context], contexts)
    model = b"".join([np.array([len(held), len(pairs)], np.int64).tobytes(), words[held].tobytes(), per_word[held].astype(np.uint32).tobytes(), packed, narrow(total)])
    asked, trained = distinct(np.concatenate([names[~used].astype(np.uint64), *(np.frombuffer(r, np.uint64) for r in rests)])), names[used].astype(np.uint64)
    at = np.searchsorted(trained, asked)
    new = at == len(trained)
    new[~new] = trained[at[~new]] != asked[~new]
    return model, asked[new].tobytes()


_STIRLING: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers: the weight of n customers at t tables, up to EXACT of both; kept in a worker."""
    if discount not in _STIRLING:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(1, EXACT + 1)
        for n in range(1, EXACT):
            with np.errstate(divide="ignore", invalid="ignore"):
                stay = np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)) + out[n, 1:], -np.inf)
            out[n + 1, 1:] = np.logaddexp(stay, out[n, :-1])
        _STIRLING[discount] = out
    return _STIRLING[discount]


def seat(customers: np.ndarray, others: np.ndarray, above: np.ndarray, beneath: np.ndarray, opens: np.ndarray | None, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given all other dishes: t tables weigh the Stirling number of (customers, t) times, for
    each table after the first, (others + discount x tables before) x its probability in the parent.

    others: concentration and discounts of the restaurant's other tables. above / beneath: the parent's probability of
    the dish once it has the first table. Each further table is one more customer of the parent, less the discount of
    the table that it may open there, `opens` over above; without `opens` the parent is a fixed law. Draws are the
    largest of weights with Gumbel noise. Dishes of over EXACT customers, whose tables are a small part of them, are
    seated one customer after the other, in batches of up to a twentieth of who sits.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    weights = stirling(discount)
    rows = np.flatnonzero((customers > 1) & (customers <= EXACT))
    n = customers[rows]
    log, numerator = np.zeros(len(rows)), above[rows].astype(float)
    best = weights[n, 1] + rng.gumbel(size=len(rows))
    t = 1
    while len(rows):
        log += np.log((others[rows] + discount * t) * numerator / (beneath[rows] + (t - 1 if opens is not None else 0)))
        if opens is not None:
            numerator = numerator + 1 - opens[rows] / numerator
        t += 1
        drawn = weights[n, t] + log + rng.gumbel(size=len(rows))
        tables[rows[drawn > best]] = t
        best = np.maximum(best, drawn)
        more = n > t
        rows, n, log, numerator, best = rows[more], n[more], log[more], numerator[more], best[more]
    left, seated = np.flatnonzero(customers > EXACT), tables.copy()
    while len(left):
        n, t = seated[left], tables[left]
        come = np.minimum(customers[left] - n, np.maximum(1, n // 20))
        grown = 0 if opens is None else (t - 1) * (1 - opens[left] / above[left])
        new = (others[left] + discount * t) * (above[left] + grown) / (beneath[left] + (0 if opens is None else t - 1))
        tables[left] = t + rng.binomial(come, np.clip(new / (new + n - discount * t), 0, 1))
        seated[left] = n + come
        left = left[customers[left] > seated[left]]
    return tables


class Partition:
    """The restaurants' dishes of one partition of the vocabulary.

    By a book, contexts are places in `names`, all that the partition's blocks ask for: those of dishes and `rest`. By
    classes they are the classes themselves.
    """

    def __init__(self, number: int, data: bytes, contexts: int | Book, rest: bytes = b"") -> None:
        self.number, self.contexts = number, contexts
        self.names, self.read = None, contexts
        if isinstance(contexts, int):
            self.words, per_word, named, self.counts = unpack(data, contexts)
            self.n_contexts, self.context = contexts, named.astype(np.int64)
        else:
            self.words, per_word, (short, hashes), self.counts = unpack(data, Split(contexts))
            self.names = contexts.names(short, hashes, np.frombuffer(rest, np.uint64))
            self.read = Places(self.names, contexts)
            self.n_contexts, self.context = len(self.names), self.read.find(short, hashes)
        self.word = np.repeat(np.arange(len(self.words)), per_word)
        self.code = self.word * self.n_contexts + self.context
        self.total = np.bincount(self.word, self.counts, len(self.words)).astype(np.int64)
        self.tables = np.maximum(1, np.sqrt(self.counts)).astype(np.int64)  # nearer to where sweeps lead than one table each
        self.parent_tables = np.ones(len(self.words), np.int64)

    def of_context(self, numbers: np.ndarray) -> np.ndarray:
        """Sums of the dishes' numbers by context."""
        return np.bincount(self.context, numbers, self.n_contexts).astype(np.int64)

    def by_owner(self, owners: int) -> list[tuple[int, int, int]]:
        """Owners of contexts, and the first and last place of theirs."""
        owner = ((self.names >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(1, np.int64)
        return [(int(owner[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def single(self) -> list[int]:
        """Totals over all dishes, as `Model.ONE` names them."""
        found = (self.parent_tables.sum(), self.tables.sum(), self.counts.sum(), len(self.words), (self.total == 1).sum(), (self.total == 2).sum(), (self.counts == 1).sum(), (self.counts == 2).sum())
        return [int(x) for x in found]

    def customers(self) -> np.ndarray:
        return np.bincount(self.word, self.tables, len(self.words))

    def parent(self, law: dict) -> np.ndarray:
        """The shared parent's probability of each word."""
        mass = (law["theta0"] + law["d0"] * law["T0"]) / (law["theta0"] + law["C0"])
        return (self.customers() - law["d0"] * self.parent_tables) / (law["theta0"] + law["C0"]) + mass * law["known"]

    def sweep(self, law: dict, nth: int) -> None:
        rng = np.random.default_rng([2, self.number, nth])
        # The parent without a dish's own tables in a restaurant, but with one customer for the first of the new ones.
        rest = self.customers()[self.word] - self.tables
        tables = np.maximum(1, np.minimum(self.parent_tables[self.word], rest))
        mass = (law["theta0"] + law["d0"] * (law["T0"] - self.parent_tables[self.word] + tables)) * law["known"]
        above, beneath = rest + 1 - law["d0"] * tables + mass, law["theta0"] + law["C0"] - self.tables + 1
        others = law["theta1"] + law["d1"] * (law["t"][self.context] - self.tables)
        self.tables = seat(self.counts, others, above, beneath, law["d0"] * mass, law["d1"], rng)
        others = law["theta0"] + law["d0"] * (law["T0"] - self.parent_tables)
        base = np.full(len(self.words), law["known"])
        self.parent_tables = seat(self.customers().astype(np.int64), others, base, np.ones(len(self.words)), None, law["d0"], rng)

    def answer(self, data: bytes, states: list[tuple[dict, np.ndarray, np.ndarray]]) -> bytes:
        """Of a block's request: training counts of its words, log10 of the averaged probability of its pairs."""
        words, per_word, context, _ = unpack(data, self.read)
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        known = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        word, context = np.repeat(at, per_word), context.astype(np.int64)
        code, want = self.code, word * self.n_contexts + context
        pair = np.minimum(np.searchsorted(code, want), max(0, len(code) - 1))
        seen = np.repeat(known, per_word) & (code[pair] == want if len(code) else False)
        total = np.zeros(len(want))
        for law, tables, parent in states:
            mass = (law["theta0"] + law["d0"] * law["T0"]) / (law["theta0"] + law["C0"])
            above = np.full(len(want), mass * law["unknown"])
            if len(self.words):
                above = np.where(np.repeat(known, per_word), parent[word], above)
            own = np.zeros(len(want))
            own[seen] = self.counts[pair[seen]] - law["d1"] * tables[pair[seen]]
            total += (own + (law["theta1"] + law["d1"] * law["t"][context]) * above) / (law["theta1"] + law["c"][context])
        c = np.where(known, self.total[at] if len(self.words) else 0, 0).astype(np.int64)
        return np.array([len(c), len(want)], np.int64).tobytes() + c.tobytes() + np.log10(total / len(states)).astype(np.float32).tobytes()


def bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """The rows as a table in buckets of a key, by which they are dealt out already: it meets other rows and stays where it is."""
    spark, name = df.sparkSession, f"pitman_yor_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def summed(seats: DataFrame, contexts: int | Book, most_buckets: int) -> tuple[list[int], DataFrame | None]:
    """Partitions of several slices, and home, part, model, rest of what all slices of such a partition have counted.

    They are at most one slice for each `slice_bytes` of requests, and only models and contexts are shuffled.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        model, rest = gathered_with_rest(pdf["model"].tolist(), pdf["rest"].tolist(), contexts)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "slice": [int(pdf["slice"].iloc[0])], "model": [model], "rest": [rest]})

    cut = {r["part"]: r["most"] for r in seats.groupBy("part").agg(F.count("*").alias("n"), F.max("slice").alias("most")).filter("n > 1 or most > 0").collect()}
    if not cut:
        return [], None
    sums, most = seats.filter(F.col("part").isin(list(cut))).select("part", "slice", "model", "rest"), max(cut.values())
    while most > 0:
        most //= 16
        sums = sums.withColumn("slice", F.floor(F.col("slice") / 16).cast("int")).groupBy("part", "slice").applyInPandas(add, "part int, slice int, model binary, rest binary")
    homes = sums.select(F.col("part").cast("long").alias("home"), "part", "model", "rest")
    buckets = min(len(cut), most_buckets)
    return list(cut), bucketed(homes.repartition(buckets, "home"), "sums", "home", buckets)


def totals_of(names: list[bytes], numbers: list[bytes], book: Book) -> list[bytes]:
    """Of an owner: partitions' numbers of their contexts, each with the total over all partitions in its place."""
    each = [widen(x) for x in numbers]
    named, of_all = [book.split(n, len(x)) for n, x in zip(names, each, strict=True)], np.concatenate(each)
    short = np.concatenate([n[0] for n in named])
    total = np.bincount(short, of_all, book.LONG + 1).astype(np.int64)[short]
    long = short == book.LONG
    _, which = np.unique(np.concatenate([n[1] for n in named]), return_inverse=True)
    total[long] = np.bincount(which, of_all[long]).astype(np.int64)[which]
    return [narrow(x) for x in np.split(total, np.cumsum([len(x) for x in each])[:-1])]


class Model:
    """Partitions at their homes, what owners know of contexts, and the laws and seating after each sweep.

    seats: home, part, model, rest, requests. A home is a partition, or one of its slices; where it is cut, `sums` has what
    all slices have counted. owned: owner, home, and a partition's contexts of this owner with their customers and tables.
    Owners are ranges of hashes, and so are contexts in the order of a partition's names.
    """

    ONE = ("T0", "C0", "tokens", "V", "word1", "word2", "pair1", "pair2")

    def __init__(self, seats: DataFrame, contexts: Book, owners: int, unknown: float, theta: float, most_buckets: int = 50_000) -> None:
        self.seats, self.contexts, self.owners, self.sweeps = seats, contexts, owners, {}
        self.cut, sums = summed(seats, contexts, most_buckets)
        self.sums, whole = sums, seats.filter(~F.col("part").isin(self.cut)).select("home", "part", "model", "rest")
        self.places = [whole, sums] if self.cut else [whole]
        buckets = min(owners, most_buckets)
        self.owned = bucketed(self._started().repartition(buckets, "owner"), "owned", "owner", buckets)
        one = self._singles(self.owned)
        discount = lambda n1, n2: min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        self.tokens, self.types = one["tokens"], one["V"]
        fixed = {"theta0": theta, "theta1": theta, "d0": discount(one["word1"], one["word2"]), "d1": discount(one["pair1"], one["pair2"]), "unknown": unknown, "known": (1 - unknown) / max(1, self.types)}
        if not self.types:
            fixed["unknown"] = 1.0
        self.laws = [fixed | {"T0": float(one["T0"]), "C0": float(one["C0"])}]
        for k in range(1, BURN_IN + SAMPLES + 1):
            self.sweeps[k] = materialize(self._swept(k), "pitman-yor-sweep", compression="zstd")
            one = self._singles(self.sweeps[k])
            self.laws.append(fixed | {"T0": float(one["T0"]), "C0": float(one["C0"])})

    def _singles(self, rows: DataFrame) -> dict[str, int]:
        found = rows.filter("owner = -1").agg(*(F.sum(F.col("one")[i]).alias(k) for i, k in enumerate(self.ONE))).first()
        return {k: int(found[k] or 0) for k in self.ONE}

    def _started(self) -> DataFrame:
        """Each partition's contexts by owner, and its single totals (owner -1), before any sweep."""
        book, owners = self.contexts, self.owners

        def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for home, part, data, rest in zip(pdf["home"], pdf["part"], pdf["model"], pdf["rest"], strict=True):
                    p = Partition(part, data, book, rest)
                    c, t = p.of_context(p.counts), p.of_context(p.tables)
                    rows = [(home, o, book.pack(p.names[a:b]), narrow(c[a:b]), narrow(t[a:b]), None) for o, a, b in p.by_owner(owners)]
                    yield pd.DataFrame([*rows, (home, -1, None, None, None, p.single())], columns=["home", "owner", "names", "c", "t", "one"])

        shape = "home long, owner int, names binary, c binary, t binary, one array<long>"
        rows = [x.mapInPandas(start, shape) for x in self.places]
        return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    def _totals(self, of: str, k: int = 0) -> DataFrame:
        """home, what, owner, data: totals of the contexts that each partition has with an owner; c, or t after k sweeps."""
        book, what = self.contexts, f"{of}{k}"

        def answer(held: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
            data = totals_of(held["names"].tolist(), numbers[of].tolist(), book) if len(held) else []
            return pd.DataFrame({"home": held["home"], "what": what, "owner": held["owner"], "data": data})

        def first(held: pd.DataFrame) -> pd.DataFrame:
            return answer(held, held)

        def later(held: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            held, sent = held.sort_values("home", ignore_index=True), sent.sort_values("home", ignore_index=True)
            assert held["home"].equals(sent["home"]), "each partition has sent its tables"
            return answer(held, sent)

        shape, owned = "home long, what string, owner int, data binary", self.owned.filter("owner >= 0")
        if not k:
            return owned.select("owner", "home", "names", of).groupBy("owner").applyInPandas(first, shape)
        sent = self.sweeps[k].filter("owner >= 0").select("owner", "home", of)
        return owned.select("owner", "home", "names").groupBy("owner").cogroup(sent.groupBy("owner")).applyInPandas(later, shape)

    def _seating(self, k: int) -> DataFrame:
        """home, what, owner, data: the tables and the parent's tables after k sweeps."""
        rows = self.sweeps[k].filter("owner = -1")
        kept = lambda column: rows.select("home", F.lit(f"{column}{k}").alias("what"), "owner", F.col(column).alias("data"))
        return kept("t_of_dish").unionByName(kept("parents"))

    def _swept(self, k: int) -> DataFrame:
        """A sweep: each partition's tables by owner, its seating and single totals (owner -1)."""
        book, owners, law = self.contexts, self.owners, self.laws[k - 1]

        def sweep(seat: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            home, p, told = int(seat["home"].iloc[0]), Partition(int(seat["part"].iloc[0]), seat["model"].iloc[0], book, seat["rest"].iloc[0]), Told(told)
            if k > 1:
                p.tables, p.parent_tables = told[f"t_of_dish{k - 1}"], told[f"parents{k - 1}"]
            p.sweep(law | {"t": told[f"t{k - 1}"]}, k)
            t = p.of_context(p.tables)
            rows = [(home, o, narrow(t[a:b]), None, None, None) for o, a, b in p.by_owner(owners)]
            return pd.DataFrame([*rows, (home, -1, None, narrow(p.tables), narrow(p.parent_tables), p.single())], columns=["home", "owner", "t", "t_of_dish", "parents", "one"])

        told = self._totals("t", k - 1)
        if k > 1:
            told = told.unionByName(self._seating(k - 1))
        shape = "home long, owner int, t binary, t_of_dish binary, parents binary, one array<long>"
        here = [(self.places[0], told)] if not self.cut else [(self.places[0], told.filter(~F.col("home").isin(self.cut))), (self.places[1], told.filter(F.col("home").isin(self.cut)))]
        rows = [seats.groupBy("home").cogroup(t.groupBy("home")).applyInPandas(sweep, shape) for seats, t in here]
        return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])

    def answers(self) -> DataFrame:
        book, laws, states = self.contexts, self.laws, range(BURN_IN + 1, BURN_IN + SAMPLES + 1)

        def reply(seat: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            told, seat = Told(told), seat.iloc[0]
            model, rest = (told.raw.get(f"{k}0", seat[k]) for k in ("model", "rest"))
            p, held = Partition(int(seat["part"]), model, book, rest), []
            for k in states:
                p.tables, p.parent_tables = told[f"t_of_dish{k}"], told[f"parents{k}"]
                law = laws[k] | {"t": told[f"t{k}"], "c": told["c0"]}
                held.append((law, p.tables, p.parent(law)))
            rows = [(r["chunk"], p.number, p.answer(r["data"], held)) for r in seat["requests"]]
            return pd.DataFrame(rows, columns=["chunk", "part", "data"])

        told = self._totals("c")
        for k in states:
            told = told.unionByName(self._totals("t", k)).unionByName(self._seating(k))
        if self.cut:
            for k in ("model", "rest"):
                told = told.unionByName(self.sums.select("home", F.lit(f"{k}0").alias("what"), F.lit(-1).alias("owner"), F.col(k).alias("data")))
            slices = self.seats.filter(F.col("part").isin(self.cut)).select(F.col("part").cast("long").alias("whole"), F.col("home").alias("slice_home"))
            copies = told.join(slices, F.col("home") == F.col("whole")).select(F.col("slice_home").alias("home"), "what", "owner", "data")
            told = told.filter(~F.col("home").isin(self.cut)).unionByName(copies)
        seats = self.seats.select("home", "part", "model", "rest", "requests")
        return seats.groupBy("home").cogroup(told.groupBy("home")).applyInPandas(reply, "chunk long, part int, data binary")


class Told:
    """What a partition is told: numbers by what they are, in the order of the owners they come from."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("owner")
        self.numbers = {what: of["data"].tolist() for what, of in rows.groupby("what", sort=False)}
        self.raw = {what: data[0] for what, data in self.numbers.items()}

    def __getitem__(self, what: str) -> np.ndarray:
        return np.concatenate([widen(x) for x in self.numbers[what]])


def score(
    docs: DataFrame, held_out_of: int = 7, held_out: int = 2, unknown: float = 0.5, theta: float = 1.0, chunk_bytes: int = 12 << 20, part_bytes: int = 8 << 20,
    slice_bytes: int = 16 << 20, context_bytes: int = 1 << 12, most_contexts: int = 1 << 16, most_buckets: int = 50_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (10 to the power of -score / n_tokens)."""
    spark = docs.sparkSession
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks, parts = max(1, -(-volume // chunk_bytes)), max(8, -(-volume // part_bytes))
    contexts, buckets = frequent(docs, volume, context_bytes, most_contexts), min(chunks, most_buckets)
    name = f"pitman_yor_{uuid.uuid4().hex}"
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of

    @F.pandas_udf("long")
    def nth_block(lengths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """The number of a row's block within its task: rows in order, each block of about `chunk_bytes`."""
        held = 0
        for n in lengths:
            upto = held + n.to_numpy(np.int64).cumsum()
            held = int(upto[-1]) if len(upto) else held
            yield pd.Series(upto // chunk_bytes)

    # Blocks are runs of rows of one task, so that each task writes the files of its own few blocks only.
    block = F.shiftleft(F.spark_partition_id().cast("long"), 32) + nth_block.asNondeterministic()(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    rows = docs.select(block.alias("chunk"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"), "text")
    rows.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    held = spark.table(name)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        made = list(Chunk(pdf["text"].tolist(), parts, contexts).requests(~pdf["held_out"].to_numpy(bool)))
        return pd.DataFrame({"part": [p for p, _ in made], "chunk": int(pdf["chunk"].iloc[0]), "data": [d for _, d in made]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["chunk"].tolist(), pdf["data"], strict=True))
        asked = [{"chunk": c, "data": without_counts(d)} for c, d in rows]
        home, part, piece = (int(pdf[k].iloc[0]) for k in ("home", "part", "slice"))
        model, rest = gathered_with_rest([d for _, d in rows], [], contexts)
        return pd.DataFrame({"home": [home], "part": [part], "slice": [piece], "model": [model], "rest": [rest], "requests": [asked]})

    # A block takes its own request for that of every block, and so has the slices that these would fill to choose from.
    slices = F.greatest(F.lit(1), F.ceil(F.octet_length("data") * F.lit(float(chunks)) / slice_bytes))
    asked = held.groupBy("chunk").applyInPandas(ask, "part int, chunk long, data binary").withColumn("slice", F.pmod(F.xxhash64("chunk"), slices).cast("int"))
    homes = min(parts, most_buckets)
    dealt = asked.withColumn("home", F.col("part") + F.lit(parts).cast("long") * F.col("slice")).repartition(homes, "home")
    shape = "home long, part int, slice int, model binary, rest binary, requests array<struct<chunk:bigint,data:binary>>"
    seats = bucketed(dealt.groupBy("home").applyInPandas(gather, shape), "seats", "home", homes)
    model = Model(seats, contexts, max(8, parts // PARTS_OF_OWNER), unknown, theta, most_buckets)
    tokens, spread = model.tokens, np.log10(model.tokens + model.types + 1)

    def total(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        chunk, counts, logs = Chunk(pdf["text"].tolist(), parts, contexts), [], []
        for data in replies.sort_values("part")["data"]:
            n, m = (int(x) for x in np.frombuffer(data, np.int64, 2))
            counts.append(np.frombuffer(data, np.int64, n, 16))
            logs.append(np.frombuffer(data, np.float32, m, 16 + 8 * n))
        count = np.concatenate(counts)[chunk.word_of]
        log = np.concatenate(logs).astype(np.float64)[chunk.pair_of]
        starts = np.concatenate([[0], np.cumsum(chunk.lengths)[:-1]])
        base = np.log10(count + 1.0) - spread
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "n_tokens": chunk.lengths, "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
            "train_tokens": tokens, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(log, starts),
        })

    replies = model.answers()
    shape = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = held.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(total, shape)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
