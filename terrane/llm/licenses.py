"""Licence scan by a positional index of rare tokens (DataFrame functions only).

One pass counts in how many documents each word of the licence templates occurs. The index holds the rarest of each
template's words with their positions in it. A second pass looks up each text's words of the index, rarest first,
takes a template position from each text position, and keeps the begins at which enough postings of a template agree
(sorted begins put the agreeing ones side by side). There the template's mandatory key phrases are looked for, and the
share of its words that stand there is measured. All of this happens within a row: nothing but the counts is shuffled.

The index is bounded by the templates, which are fixed; so are the counts that the driver gathers.

Defined results: a null text is an empty one; rows that repeat get the same labels each; a text may have any number of
labels; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# Common licence notices as words, and the phrases that each must hold.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "this project is licensed under the terms of the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license version 2 0", "in compliance with the license")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("terms of the gnu general public license", "free software foundation")),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "waived all copyright")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of a fixed vocabulary occurs."""
    held = docs.select(F.explode(F.array_intersect(_texts(vocabulary), words_of(F.col("text")))).alias("word"))
    return {r["word"]: r["df"] for r in held.groupBy("word").agg(F.count("*").alias("df")).collect()}


def rarest(templates: tuple[Template, ...], df: dict[str, int], most: int) -> list[tuple[int, list[str]]]:
    """Of each template the postings that must agree and its indexed words: the rarer half of its words, 3 at least and `most` at most; ties by the word."""
    out = []
    for t in templates:
        words = sorted(set(t.text.split()), key=lambda w: (df.get(w, 0), w))
        kept = words[: max(3, min(most, len(words) // 2))]
        out.append((max(2, len(kept) // 2), kept))
    return out


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def base_places(words: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    """array<struct<at, label>>: where phrases stand, in words from 0."""

    def at(word: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<at:int,label:string>")
        for phrase, label in reversed(phrases):
            first, *rest = phrase.split()
            stands = word == first
            for k, other in enumerate(rest, 1):
                stands = stands & F.coalesce(F.get(words, i + k) == other, F.lit(False))
            out = F.when(stands, F.struct(i.alias("at"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(words, at), lambda x: x.isNotNull())


def template_begins(words: Column, looked: Column, templates: tuple[Template, ...], index: list[tuple[int, list[str]]]) -> Column:
    """array<struct<t, at>>: begins (in words, below 0 where a text starts within a template) at which enough postings of template t agree."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, ((_, kept), template) in enumerate(zip(index, templates, strict=True)):
        for position, word in enumerate(template.text.split()):
            if word in kept:
                postings.setdefault(word, []).append((t, position))
    lists = F.create_map(*[x for word, held in postings.items() for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in held]))])
    need = F.array(*[F.lit(n) for n, _ in index])
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(looked, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    votes = F.array_sort(F.flatten(F.transform(places, lambda x: F.transform(lists[x["w"]], lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("at"))))))
    # Sorted, n equal votes stand side by side: the last of them equals the one n - 1 before it.
    agreed = lambda v: F.filter(v, lambda x, i: F.coalesce(F.get(v, i - F.element_at(need, x["t"] + 1) + 1) == x, F.lit(False)))
    return F.array_distinct(_bound(votes, agreed))


def verified(words: Column, begins: Column, templates: tuple[Template, ...], slack: int, share: float) -> Column:
    """array<struct<label, share>> of the begins around which all key phrases and enough of the template's words stand."""
    known = F.array(*[F.struct(F.lit(t.label).alias("label"), _texts(dict.fromkeys(t.text.split())).alias("words"), F.lit(len(t.text.split())).alias("n"), _texts(f" {k} " for k in t.keys).alias("keys")) for t in templates])

    def judged(b: Column) -> Column:
        def near(t: Column) -> Column:
            start = F.greatest(b["at"] - slack, F.lit(0))
            return F.slice(words, start + 1, b["at"] + t["n"] + slack - start)

        def measured(x: Column) -> Column:
            flat = F.concat(F.lit(" "), F.array_join(x["near"], " "), F.lit(" "))
            part = F.size(F.array_intersect(x["t"]["words"], x["near"])) / F.size(x["t"]["words"])
            keyed = _bound(flat, lambda f: F.forall(x["t"]["keys"], lambda k: F.contains(f, k)))
            return F.struct(x["t"]["label"].alias("label"), F.when(keyed, part).otherwise(0.0).alias("share"))

        return _bound(_bound(F.element_at(known, b["t"] + 1), lambda t: F.struct(t.alias("t"), near(t).alias("near"))), measured)

    return F.filter(F.transform(begins, judged), lambda x: x["share"] >= share)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, most: int = 8, slack: int = 4, share: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 where a phrase of the base stands, else the largest share of a verified template's words, else 0.
    """
    df = document_frequencies(docs, sorted({w for t in templates for w in t.text.split()}))
    index = rarest(templates, df, most)
    by_rarity = sorted({w for _, kept in index for w in kept}, key=lambda w: (df.get(w, 0), w))
    phrase = "|".join(BETWEEN.join(p.split()) for p, _ in PHRASES)
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    read = docs.select("doc_id", text.alias("text")).select("doc_id", F.col("text").rlike(phrase).alias("hinted"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    looked = read.select("doc_id", "hinted", "words", F.array_intersect(_texts(by_rarity), "words").alias("looked"))
    begins = F.when(F.size("looked") >= 2, template_begins(F.col("words"), F.col("looked"), templates, index)).otherwise(F.expr("cast(array() as array<struct<t:int,at:int>>)"))
    base = F.when(F.col("hinted"), base_places(F.col("words"), PHRASES)).otherwise(F.expr("cast(array() as array<struct<at:int,label:string>>)"))
    placed = looked.select("doc_id", "words", base.alias("base"), begins.alias("begins"))
    found = F.when(F.size("begins") > 0, verified(F.col("words"), F.col("begins"), templates, slack, share)).otherwise(F.expr("cast(array() as array<struct<label:string,share:double>>)"))
    judged = placed.select("doc_id", F.size("words").cast("long").alias("n_words"), "base", found.alias("found"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return judged.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"), F.array_max("base.at").cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat(F.col("base.label"), F.col("found.label"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
    )
