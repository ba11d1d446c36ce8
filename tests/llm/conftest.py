"""Inputs of the operators' tests: a driver folder, a folder of odd rows, and one of empty tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside; as columns of the input they must do no harm.
CLASHING = ("score", "size", "fp", "block", "h", "base", "mentions", "target", "spans", "items", "n_words", "row", "shard", "slot", "chunk", "held_out", "marks", "host", "root", "pattern", "_found", "copies", "bucket")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def odd_documents() -> list[tuple]:
    rng = random.Random(7)
    words = "the of and ground river light stone paper would could about under after again house night".split()
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "one two three"), (7, "ONE two THREE"), (8, LONG), (9, LONG + " tail end"),
        (10, "mail a.b@c.de, x@y.z.w and @no@b.c 10.0.0.1 1.2.3.4.5.6.7.8 300.1.1.1 +1 (202) 555-0143 4111 1111 1111 1111 4111-1111-1111-1112"),
        (11, "é😀 mail q@w.io 😀 +44 20 7946 0958. 0.0.0.0000255 a@b.co_x@d.e +12345 +1234567890123456 12345678901234 79927398713000"), (12, passage), (13, "start " + passage + " end"), (14, passage + " " + passage),
        (None, "no id here " + passage), (15, "repeated row"), (15, "repeated row"), (15, "same id, other text"), (16, " nbsp em \x0b vt \x1c fs \x85 nel"), (17, "ſtrange K kelvin İ dotted"), (18, "x" * 5000),
    ]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))) for i in range(60)]
    rows += [(200 + i, "copy of " + passage) for i in range(40)]
    rows += [(300 + i, f"contact desk reach us at user{i}@mail.example.org today") for i in range(40)] + [(350 + i, f"or reach us at nobody@host{i} today") for i in range(4)]
    return rows


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory) -> str:
    folder = str(tmp_path_factory.mktemp("odd"))
    clash = lambda df: df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, c in enumerate(CLASHING)})
    docs = spark.createDataFrame([(i, t, "en", ("a", "b", None, "Z", "é")[n % 5], len(t or "")) for n, (i, t) in enumerate(odd_documents())], "doc_id long, text string, lang string, source string, n_chars long")
    clash(docs).repartition(3).write.parquet(f"{folder}/documents.parquet")
    passage = odd_documents()[11][1]
    items = [(1, passage), (2, "one two three"), (3, None), (4, ""), (5, "copy of the"), (None, passage), (6, "?!"), (1, "one"), (7, "w0x0 W1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10")]
    clash(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, n % 2, 0) for n, i in enumerate(range(100, 160))] + [(100, 1, 0), (None, 1, 0), (9999, 1, 0), (101, None, None)]
    clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).write.parquet(f"{folder}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [((i * 7 + j * 3) % 11 - 5) / 8 for j in range(6)]) for i in range(0, 130)] + [(50, [1.0] * 6), (7, [0.5] * 6), (200, None), (None, [1.0] * 6), (201, [1.0, None]), (202, [nan] * 6), (203, [inf] * 6), (250, []), (251, [0.5, 0.25])]
    clash(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Title {0}</h1><p>Body &amp; text {0} caf&eacute; <b>bold</b>\n more.</p></article><aside>Buy now</aside><div class='comments'><p>nice {0}</p></div><footer>(c)</footer></body></html>"
    pages = [(i, "http://h.example/x/%d" % i, page.format(i)) for i in range(20)] + [(20, None, None), (21, "not a url", ""), (22, "http://z.example/", "<p>only <p>broken &lt;tags"), (0, "http://h.example/x/0", page.format(0)), (None, "http://h.example/n", page.format("n")), (23, "http://h.example/deep", "<div>" * 3000 + "deep text"), (24, "http://h.example/c", "<!-- open comment <p>x</p>"), (25, "http://h.example/m", "<![CDATA[ x ]]><p>after</p><?php echo 1 ?>")]
    clash(spark.createDataFrame(pages, "page_id long, url string, html string")).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory) -> str:
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").filter("false").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(params=["driver", "odd", "empty"])
def folder(request) -> str:
    return "/root/testdata/sf0.001" if request.param == "driver" else request.getfixturevalue(f"{request.param}_dir")
