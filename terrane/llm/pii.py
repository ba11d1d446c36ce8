"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Four regular kinds seed the method. The two words before a seed form a lexical pattern (of a mention, the
two words since the mention before); patterns and the
identifier-like mentions they precede form a bipartite graph, on which Spark alternately scores patterns
(the share of their distinct instances that is believed) and instances (noisy-or of their patterns).
Mentions of high score are then personal data too, though no regular expression of the seeds covers them.

Defined results: a null text is an empty one; an empty text has no spans; rows that repeat each get the
same spans; ties in a span's start are in the order of KINDS; columns of the input other than doc_id and
text are not read; a null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")

# Each finds the leftmost, non-overlapping matches of the plain definition, but starts only where a match
# can start and never backtracks over a run, so that long runs of one class cost linear time. The card
# pattern holds its limits of 14 to 19 digits for whole chains of digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A word that holds a digit or an at sign: what a pattern can discover.
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Shapes that a mention of a kind must have, without the edge punctuation.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^(?=.*[:.].*[:.])[0-9A-Fa-f:.]{6,45}$",
    "card": r"^[0-9]([-.]?[0-9]){11,18}$",
    "phone": r"^[(+]?[0-9]([-.()/]*[0-9]){6,14}$",
}


#: Matches are placed in blocks of this many, so that a text with n of them costs n x BLOCK + (n / BLOCK)^2 steps.
BLOCK = 128
#: A private-use character that stands for the characters of base spans, where mentions are looked for.
FILLER = "\ue000"
NO_SPANS = "cast(array() as array<struct<m:string,s:int,e:int,before:string>>)"


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def found(text: Column, pattern: str) -> Column:
    """array<struct<m, s, e, before>>: the matches, their places in code points (end exclusive) and the text since the match before, after a space at the text's begin."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    pairs = F.transform(F.filter(zipped, lambda p: p["m"].isNotNull()), lambda p, i: F.struct(p["m"].alias("m"), F.when(i == 0, F.concat(F.lit(" "), p["gap"])).otherwise(p["gap"]).alias("before"), F.length(p["gap"]).alias("g"), F.length(p["m"]).alias("n")))
    length = lambda part: F.aggregate(part, F.lit(0), lambda a, p: a + p["g"] + p["n"])
    blocks = lambda all_pairs: F.transform(F.sequence(F.lit(0), F.floor(F.size(all_pairs) / BLOCK).cast("int")), lambda b: F.slice(all_pairs, b * BLOCK + 1, F.lit(BLOCK)))
    summed = lambda cut: F.struct(cut.alias("cut"), F.transform(cut, length).alias("sums"))
    started = lambda x: F.transform(x["cut"], lambda part, i: F.struct(part.alias("part"), F.aggregate(F.slice(x["sums"], F.lit(1), i), F.lit(0), lambda a, n: a + n).alias("start")))

    def placed(block):
        at = lambda p, j: block["start"] + length(F.slice(block["part"], F.lit(1), j)) + p["g"]
        return F.transform(F.transform(block["part"], lambda p, j: F.struct(p.alias("p"), at(p, j).alias("s"))), lambda x: F.struct(x["p"]["m"].alias("m"), x["s"].alias("s"), (x["s"] + x["p"]["n"]).alias("e"), x["p"]["before"].alias("before")))

    return _bound(_bound(_bound(pairs, blocks), summed), lambda x: F.flatten(F.transform(started(x), placed)))


def masked(text: Column, kind: str) -> Column:
    """The text with the valid matches of a kind replaced by fillers of their length."""
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("gap"))
    hidden = lambda m: F.repeat(F.lit(FILLER), F.length(m))
    shown = lambda m: hidden(m) if kind == "email" else F.when(_valid(kind, m), hidden(m)).otherwise(m)
    return F.array_join(F.transform(zipped, lambda p: F.when(p["m"].isNull(), p["gap"]).otherwise(F.concat(p["gap"], shown(p["m"])))), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column | None:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3
        small = lambda p: F.regexp_replace(p, "^0+(?=.)", "").cast("int") <= 255
        return F.forall(F.split(m, r"\."), lambda p: F.when(part(p), small(p)).otherwise(False))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return None


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, m, before>> of the regular kinds, by start and then kind."""
    need = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")) & text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    each = []
    for k, kind in enumerate(KINDS):
        spans = F.when(need[kind], found(text, PATTERNS[kind])).otherwise(F.expr(NO_SPANS))
        ok = (lambda kind: lambda x: _valid(kind, x["m"]))(kind)
        spans = F.filter(spans, ok) if kind != "email" else spans
        numbered = (lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before")))(k)
        each.append(F.transform(spans, numbered))
    return F.array_sort(F.concat(*each))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", kind(x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def _context(before: Column) -> Column:
    """The last two whole words of what stands before a match, lower case; null if there are fewer."""
    two = F.regexp_extract(before, r"(?<=\s)(\S++\s++\S++)\s++[^\s0-9A-Za-z@]*+$", 1)
    return F.when(two != "", F.regexp_replace(F.lower(two), r"\s+", " "))


def _core(m: Column) -> Column:
    return F.regexp_replace(m, r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$", "")


def discover(edges: DataFrame, rounds: int, least: int, confident: float) -> DataFrame:
    """(pattern, instance, kind) -> the (instance, kind) that the patterns vouch for.

    edges: distinct rows pattern, instance, kind (null: not yet known). A pattern needs `least` different
    believed instances; its confidence is their share among all its instances, shrunk by 1 / (n + 1). An
    instance's score is 1 minus the product of its patterns' doubts. Rounds end early by no new belief.
    """
    ids = edges.select("pattern", "instance").distinct()
    believed = edges.filter(F.col("kind").isNotNull()).select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    total = ids.groupBy("pattern").agg(F.count("*").alias("n"))
    known = believed
    for _ in range(rounds):
        held = ids.join(believed, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("held"), F.count("*").alias("support"))
        patterns = (
            held.filter(F.col("support") >= least).join(total, "pattern")
            .select("pattern", "kind", (F.col("held") / F.col("n") * (F.col("n") / (F.col("n") + 1.0))).alias("confidence"))
            .filter(F.col("confidence") >= confident)
        )
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        scored = ids.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        shape = F.lit(False)
        for kind in KINDS:
            shape = shape | ((F.col("kind") == kind) & F.col("instance").rlike(SHAPES[kind]))
        new = scored.filter((F.col("score") >= confident) & shape)
        believed = materialize(known.unionByName(new).groupBy("instance", "kind").agg(F.max("score").alias("score")), "pii-beliefs")
    return believed.join(known.select("instance", "kind"), ["instance", "kind"], "left_anti")


def extract(docs: DataFrame, rounds: int = 2, least: int = 5, confident: float = 0.8) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans (base and discovered), n_found (discovered), n_spans (all)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    per_doc = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).select("doc_id", "text_key", base_spans(F.col("text")).alias("base"), F.col("text").alias("rest"))
    for k, kind in enumerate(KINDS):
        has = F.exists("base", (lambda k: lambda b: b["k"] == k)(k))
        per_doc = per_doc.withColumn("rest", F.when(has, masked(F.col("rest"), kind)).otherwise(F.col("rest")))
    wanted = F.when(F.col("rest").rlike("[0-9@]"), found(F.col("rest"), MENTION)).otherwise(F.expr(NO_SPANS))
    lead = lambda x: F.length(F.regexp_extract(x["m"], r"^[^0-9A-Za-z+(]*", 0))
    per_doc = per_doc.select("doc_id", "text_key", "base", wanted.alias("mentions")).select(
        "doc_id", "text_key",
        F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"), F.lower(b["m"]).alias("m"), _context(b["before"]).alias("pattern"))).alias("base"),
        F.transform(F.filter("mentions", lambda x: ~F.contains(x["m"], F.lit(FILLER))), lambda x: F.struct((x["s"] + lead(x)).alias("cs"), F.length(_core(x["m"])).alias("n"), F.lower(_core(x["m"])).alias("m"), _context(x["before"]).alias("pattern"))).alias("mentions"),
    )
    per_doc = materialize(per_doc, "pii-spans")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("b.k") + 1)
    seeds = per_doc.select(F.explode("base").alias("b")).select(F.col("b.pattern").alias("pattern"), F.col("b.m").alias("instance"), kind.alias("kind"))
    loose = per_doc.select("doc_id", "text_key", F.explode("mentions").alias("b")).filter((F.col("b.n") >= 5) & F.col("b.pattern").isNotNull())
    edges = seeds.filter(F.col("pattern").isNotNull()).unionByName(loose.select(F.col("b.pattern").alias("pattern"), F.col("b.m").alias("instance"), F.lit(None).cast("string").alias("kind"))).distinct()
    new = discover(materialize(edges, "pii-graph"), rounds, least, confident)
    # A mention is taken where one of its believed kinds fits; of several, the first of KINDS.
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    best = new.groupBy("instance").agg(F.min(order).alias("k"))
    added = (
        loose.select("doc_id", "text_key", F.col("b.m").alias("instance"), F.col("b.cs").alias("s"), (F.col("b.cs") + F.col("b.n")).alias("e"))
        .join(best, "instance")
        .groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
        .agg(F.collect_set(F.struct("s", "k", "e")).alias("added"))
    )
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    apart = F.filter(F.coalesce(F.col("added"), none), lambda x: ~F.exists("base", lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"])))
    plain = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    out = per_doc.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left").withColumn("added", apart)
    of_kind = lambda k: lambda b: b["k"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat(plain, "added"))
    return out.select("doc_id", *counts, F.sha2(joined(plain), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("long").alias("n_found"), F.size(every).cast("long").alias("n_spans"))
