"""Ranked search, licence scan and collocations against their brute-force versions, and the cases their methods turn on."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import collocations, lexical, licenses, queries
from tests.llm import brute


def rows(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_search_equals_scoring_all(spark, folder):
    want = brute.ranked(rows(spark, folder, "documents", "doc_id", "text"), rows(spark, folder, "benchmark", "item_id", "text"))
    got = queries.op11_lexical(spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same(got.collect(), want)


def test_search_in_small_shards_and_batches(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(map(tuple, lexical.search(docs, items).collect()))
    for shard, batch in ((50, 1 << 20), (3000, 700)):
        assert sorted(map(tuple, lexical.search(docs.repartition(5), items, shard_postings=shard, batch_bytes=batch).collect())) == whole


def test_search_stops_early_and_keeps_ties():
    """A shard in which one list's head decides: deep entries stay unread, and all that tie with the kth are there."""
    rng = np.random.default_rng(5)
    n = 4000
    tf = np.concatenate([np.full(12, 50), rng.integers(1, 3, n - 12)])
    shard = lexical.Shard(np.full(n, 100), np.arange(n + 1), np.zeros(n, np.int64), tf, np.array([700]), n, 100 * n)
    looked = []
    lookup = shard.lookup
    shard.lookup = lambda docs, asked: (looked.append(len(docs)), lookup(docs, asked))[1]
    docs, scores = shard.best({0: 1}, np.array([1]), 10)
    assert sorted(docs) == list(range(12)) and len(set(scores)) == 1 and sum(looked) < 100


def test_search_ties_by_doc_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (9, 3, 7, None, 5)] + [(1, "other text")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "words"), (1, "words words"), (2, "absent"), (3, None), (4, "?!")], "item_id long, text string")
    got = lexical.search(docs, items, k=3).collect()
    for q in {r["score"] for r in got}:
        assert [(r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["score"] == q] == [(1, 3), (2, 5), (3, 7)]
    assert {r["item_id"] for r in got} == {1} and len(got) == 6


def test_licences_equal_trying_every_place(spark, folder):
    docs = rows(spark, folder, "documents", "doc_id", "text")
    docs = [(i, t) for i, t in docs if len(t or "") < 100_000]  # trying every place takes minutes on the longest
    want = [(i, *x) for (i, _), x in zip(docs, brute.licences([t for _, t in docs], licenses.TEMPLATES, licenses.PHRASES), strict=True)]
    table = spark.read.parquet(f"{folder}/documents.parquet").filter("text is null or length(text) < 100000")
    same(licenses.scan(table).collect(), want)


def test_licence_notices_are_found_where_they_stand(spark):
    filler = "the quick brown fox jumps over the lazy dog by the river while all others rest under version control "
    cases = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    }
    texts = [(i, filler * (i % 3) + notice + " " + filler * ((i + 1) % 4)) for i, notice in enumerate(cases.values())] + [(50 + i, filler * 5) for i in range(30)]
    texts += [(90, " ".join(cases.values())), (91, "permission hereby granted without restriction charge software free of license"), (92, "mit license"), (93, "CC by cc-BY cc. by"), (94, None), (95, ""), (96, "general public license all rights reserved " * 2000)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, label in enumerate(cases):
        assert label in got[i]["labels"].split(","), label
        assert 0.7 <= got[i]["score"] <= 1
    assert set(cases) <= set(got[90]["labels"].split(","))
    assert all(got[50 + i]["labels"] == "" and got[50 + i]["score"] == 0 for i in range(30)) and got[91]["labels"] == got[92]["labels"] == ""
    assert (got[93]["n_base"], got[93]["first_word"], got[93]["last_word"], got[93]["base_labels"]) == (3, 0, 4, "cc-by")
    assert got[94]["n_words"] == got[95]["n_words"] == 0 and got[94]["first_word"] is None
    assert (got[96]["n_base"], got[96]["last_word"], got[96]["base_labels"]) == (4000, 11_997, "gpl,reserved")


@pytest.mark.parametrize("least", [2, 5, 100])
def test_collocations_equal_counting_all(spark, folder, least):
    want = brute.collocations(rows(spark, folder, "documents", "lang", "text"), least=least, top=300)
    got = collocations.mine(spark.read.parquet(f"{folder}/documents.parquet"), least=least, top=300)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    same(got.collect(), want)


def test_collocations_over_many_tasks(spark, monkeypatch):
    """Beginnings that hold most suffixes go over many tasks; their counts are whole all the same."""
    texts = [(("en", None, "und")[i % 3], f"hot pair w{i % 41} x{i % 7}, hot hot hot\t\x01odd pair. Hot\x0bPAIR {'hot pair ' * (i % 5)}") for i in range(600)]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(7)
    monkeypatch.setattr(collocations, "HELD", 50)
    for size in (500, 5000, 1 << 20):
        same(collocations.mine(docs, least=20, partition_bytes=size).collect(), brute.collocations(texts, least=20))


def test_collocation_scores_beyond_64_bits(spark):
    n, big = 10**14, 3 * 10**12
    phrases = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    got = collocations._scores(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert got["score"] == 1000 * (big - 1) * n // (big * big)


@pytest.mark.parametrize("name", ["op11_lexical", "op13_collocations"])
def test_equals_its_sql(spark, name):
    folder, connection = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    same(got.select(*names).collect(), want.fetchall())


def test_extra_columns_do_no_harm(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "en")], "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "terms", "tfs", "suffix", "words", "looked", "base", "score", "phrase", "q", "rank")})
    items = docs.select(F.col("doc_id").alias("item_id"), "text", "score", "rank", "q")
    assert [tuple(r) for r in licenses.scan(docs).select("doc_id", "n_words").collect()] == [(1, 2)]
    assert lexical.search(docs, items).count() == 1
    assert collocations.mine(docs, least=1).count() == 1
