"""Many searches, many impacts and chunks of bodies against plain versions."""

from __future__ import annotations

import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.engine import Engine
from terrane.operators import retrieval, vector_index
from terrane.operators.reach import reach
from terrane.operators.templates import traverse
from terrane.operators.vector_index import VectorIndex
from terrane.plans import searching


@pytest.fixture
def keep(spark, tmp_path):
    """Makes a table of a step; notes the number of its rows."""
    counts = {}

    def staged(name, df):
        path = str(tmp_path / "steps" / f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        counts[name] = out.count()
        return out

    staged.counts = counts
    return staged


# --- nearest neighbours


def nearest(rows, queries, k, but_own=False):
    out = {}
    for q, v in queries:
        near = sorted((float(np.cumsum((np.array(x, float) - np.array(v, float)) ** 2)[-1]), id) for id, x in rows if not (but_own and id == q))
        out[q] = [(n + 1, id, d) for n, (d, id) in enumerate(near[:k])]
    return {q: r for q, r in out.items() if r}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    return out


def vectors(spark, rows, id="long"):
    return spark.createDataFrame(rows, f"id {id}, v array<double>")


def clustered(count, width, rng, hot=3):
    """A third of the rows around one point, the others around forty; every twentieth is a copy of the one before."""
    centers, rows = rng.normal(size=(41, width)) * 20, []
    for i in range(count):
        at = centers[0] if i % hot == 0 else centers[1 + i % 40]
        rows.append((i, rows[-1][1] if i % 20 == 19 else (at + rng.normal(size=width)).tolist()))
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_search_equals_brute_force(spark, tmp_path, keep, monkeypatch, block_bytes):
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(5)
    rows = clustered(3000, 8, rng)
    index = VectorIndex.build(vectors(spark, rows).repartition(8), str(tmp_path / "index"), "id", "v")
    assert index.blocks.agg(F.sum("n")).first()[0] == 3000 and index.blocks.filter("lo > hi").isEmpty()
    assert index.blocks.agg(F.max("n")).first()[0] <= block_bytes // 64
    queries = rows[::100] + [(10_000 + i, (rng.normal(size=8) * 30).tolist()) for i in range(20)]
    assert found(index.search(vectors(spark, queries), keep, 7, "id", "v", but_own=True)) == nearest(rows, queries, 7, but_own=True)
    if block_bytes == 2000:  # most pairs of a query and a ring are excluded by their bounds
        pairs = keep.counts["search-first"] + keep.counts["search-more"]
        assert pairs < len(queries) * index.blocks.count() / 4


def test_every_cluster_has_a_centroid_of_its_own():
    """Also where a third of the rows are in one cluster; from evenly spaced rows some clusters shared a wide cell. Copies and huge components do no harm."""
    for seed in range(8):
        rows = np.array([v for _, v in clustered(900, 8, np.random.default_rng(seed))])
        centers = vector_index.centroids(rows, 55)
        far = np.sqrt(vector_index._squares(rows, centers).min(1))
        assert far.max() < 10 and len(centers) <= 55, "clusters are tens apart, their rows about three from the middle"
    assert vector_index.centroids(np.ones((20, 2)), 5).tolist() == [[1.0, 1.0]]
    assert vector_index.centroids(np.array([[2.0], [5.0]]), 2).tolist() == [[2.0], [5.0]]
    assert np.isfinite(vector_index.seeds(np.array([[1e200], [-1e200], [0.0]]), 3)).all()


def test_search_with_ties_copies_and_few_rows(spark, tmp_path, keep):
    """Equal distances by id; more asked for than there is; a query's own row is left out only if asked for."""
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    index = VectorIndex.build(vectors(spark, rows), str(tmp_path / "index"), "id", "v")
    queries = [(0, [0.0, 0.0]), (7, [0.5, 0.0]), (99, [1.0, 3.0])]
    for k, own in ((3, False), (20, True), (100, True), (100, False)):
        assert found(index.search(vectors(spark, queries), keep, k, "id", "v", own)) == nearest(rows, queries, k, own)


def test_a_query_and_a_block_are_never_one_row(spark, tmp_path, keep, monkeypatch):
    """Rows with a block and a list of its queries took an executor's memory; ids beyond 2^53 stay as they are."""
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(vector_index, "HELD_BYTES", 5000)
    monkeypatch.setattr(vector_index, "MEET", 3)
    rng, far = np.random.default_rng(8), (1 << 60) + 1
    rows = [(far + i, rng.normal(size=8).tolist()) for i in range(300)]
    index, sent = VectorIndex.build(vectors(spark, rows), str(tmp_path / "index"), "id", "v"), []
    of = type(rows_ := spark.range(1)).mapInPandas
    monkeypatch.setattr(type(rows_), "mapInPandas", lambda self, *a, **b: sent.append(self) or of(self, *a, **b))
    queries = rows[::50] + [(5, [0.0] * 8)]
    assert found(index.search(vectors(spark, queries), keep, 4, "id", "v", but_own=True)) == nearest(rows, queries, 4, but_own=True)
    met = [s for s in sent if "vectors" in s.columns]
    assert len(met) == 2 and all(s.filter("vectors is not null and v is not null").isEmpty() for s in met)


def test_the_sample_reaches_the_driver_as_bytes(spark):
    """Python's numbers took four times the driver's memory; floats go as such, other doubles are not rounded."""
    values = np.random.default_rng(9).normal(size=(150, 3))
    for given in (values, values.astype(np.float32).astype(float)):
        frame = spark.createDataFrame([(v,) for v in given.tolist()], "v array<double>").coalesce(1)
        assert vector_index._sample(frame, 3).tolist() == given.tolist()
    assert vector_index._sample(frame.limit(0), 3).shape == (0, 3)


def test_search_leaves_out_what_is_not_a_vector(spark, tmp_path, keep):
    """Nulls, empty ones, null or non-finite components, other widths and rows without id take no part; ids may be strings."""
    nan, inf = float("nan"), float("inf")
    good = [("ä", [1.0, 2.0]), ("a", [1.0, 2.0]), ("B", [3.0, 2.0])]
    odd = [("n", None), ("e", []), ("p", [1.0, None]), ("q", [nan, 1.0]), ("r", [1.0, -inf]), ("w", [1.0, 2.0, 3.0]), (None, [1.0, 2.0])]
    index = VectorIndex.build(vectors(spark, good + odd, "string"), str(tmp_path / "index"), "id", "v")
    assert found(index.search(vectors(spark, good + odd, "string"), keep, 2, "id", "v")) == nearest(good, good, 2)
    repeated = [("x", [3.0, 2.0]), ("x", [1.0, 2.0])]
    assert found(index.search(vectors(spark, repeated, "string"), keep, 1, "id", "v")) == nearest(good, repeated[1:], 1)


@pytest.mark.parametrize("rows, queries", [([], [(1, [1.0])]), ([(1, [1.0])], []), ([(1, None)], [(1, None)])])
def test_search_of_nothing(spark, tmp_path, keep, rows, queries):
    index = VectorIndex.build(vectors(spark, rows), str(tmp_path / "index"), "id", "v")
    got = index.search(vectors(spark, queries), keep, 2, "id", "v")
    assert got.columns == ["query_id", "rank", "id", "distance"] and got.isEmpty()


def test_questions_nearest_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    chunks = [(r["chunk_id"], r["embedding"]) for r in searching._chunks(spark, folder).collect()]
    turns = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    queries = [(f"{t['conv_id']}#{t['turn']}", v) for t, v in zip(turns, retrieval.hashed_vectors([t["text"] for t in turns]).astype(float).tolist(), strict=True)]
    got = found(searching.questions_nearest(spark, folder))
    matrix = np.array([v for _, v in chunks], float)
    assert set(got) == {q for q, _ in queries}
    for q, v in queries:
        exact = np.cumsum((matrix - np.array(v)) ** 2, axis=1)[:, -1]
        want = sorted(zip(exact.tolist(), [id for id, _ in chunks], strict=True))[:10]
        assert got[q] == [(n + 1, id, d) for n, (d, id) in enumerate(want)]


# --- what many symbols reach


def walked(pairs, seeds, depth):
    ahead, out = {}, set()
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    for s in seeds:
        seen, front = {s}, {s}
        out.add((s, s, 0))
        for d in range(1, depth + 1):
            front = {y for x in front for y in ahead.get(x, ())} - seen
            seen |= front
            out |= {(s, y, d) for y in front}
    return out


@pytest.mark.parametrize("reverse", [False, True])
def test_reach_of_many_equals_single_walks(spark, keep, reverse):
    """300 seeds (five words of bits) over a graph with a hub that a third of all edges touch, cycles, loops and repeats."""
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(400)}", "n0" if i % 6 == 0 else f"n{rng.randrange(400)}") for i in range(900)] + [("n0", f"n{rng.randrange(400)}") for _ in range(150)]
    pairs += pairs[:50] + [("n1", "n1"), ("n1", "n2"), ("n2", "n1")]
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs] + [("n3", None, "CALLS"), (None, "n3", "CALLS"), ("n4", "far", "OTHER")], "source_id string, target_id string, type string")
    seeds = [f"n{i}" for i in range(299)] + ["alone"]
    wanted = spark.createDataFrame([(s,) for s in seeds + seeds[:9] + [None]], "id string")
    got = [tuple(r) for r in reach(edges, wanted, keep, ("CALLS",), 3, reverse).collect()]
    assert len(got) == len(set(got)) and set(got) == walked([p[::-1] for p in pairs] if reverse else pairs, seeds, 3)
    one = traverse(edges, spark.createDataFrame([("n7",)], "id string"), ("CALLS",), 3, reverse)
    assert {tuple(r) for r in one.collect()} == {(id, d) for s, id, d in got if s == "n7"}


def test_reach_from_no_seeds_and_without_hops(spark, keep):
    edges = spark.createDataFrame([("a", "b", "CALLS")], "source_id string, target_id string, type string")
    assert reach(edges, spark.createDataFrame([], "id string"), keep).isEmpty()
    assert [tuple(r) for r in reach(edges, spark.createDataFrame([("a",)], "id string"), keep, depth=0).collect()] == [("a", "a", 0)]
    assert {tuple(r) for r in reach(edges.filter("false"), spark.createDataFrame([("a",)], "id string"), keep).collect()} == {("a", "a", 0)}


# --- chunks of bodies


def cut(spark, text, ranges=None):
    lines = text.count("\n") + 1
    rows = [(id, "p", "method", "f", a, b) for id, a, b in ranges or [("m", 1, lines)]]
    symbols = spark.createDataFrame(rows, "id string, project_id string, kind string, file_path string, line_start long, line_end long")
    return retrieval.body_chunks(symbols, spark.createDataFrame([("p", "f", text), ("p", "other", "x;")], "project_id string, path string, text string")).orderBy("symbol_id", "line_start").collect()


def statements(count):
    return [f"    call{i % 37}(a{i});" if i % 11 else "" for i in range(count)]


def test_bodies_are_whole_and_an_inserted_line_changes_its_own_chunk(spark):
    lines = statements(400)
    before = cut(spark, "\n".join(lines))
    assert "\n".join(r["text"] for r in before if r["text"]).replace("\n", "").replace(" ", "") == "".join(lines).replace(" ", "")
    for r in before:
        size = r["text"].count("\n") + 1
        assert "\n".join(lines[r["line_start"] - 1 : r["line_start"] - 1 + size]) == r["text"]
    after = cut(spark, "\n".join(lines[:200] + ["    inserted(1);"] + lines[200:]))
    ids = [{r["chunk_id"] for r in rows} for rows in (before, after)]
    assert len(ids[0]) == len(before) > 20 and len(ids[0] - ids[1]) <= 1 and len(ids[1] - ids[0]) <= 2


def test_chunks_of_odd_bodies(spark):
    """Equal chunks are told apart, ranges may overlap and end behind the file; NULs and carriage returns at line ends go; white space makes no chunk."""
    repeated = cut(spark, "\n".join(["x();", "y();", "}", "", "{"] * 60))
    assert len({r["chunk_id"] for r in repeated}) == len(repeated) and max(Counter(r["text"] for r in repeated).values()) > 1
    got = cut(spark, "a\0b\r\nc\nd", [("m", 1, 2), ("n", 2, 9), ("o", 0, 1), ("q", 3, 2)])
    assert [(r["symbol_id"], r["text"], r["line_start"], r["chunk_type"]) for r in got] == [("m", "ab\nc", 1, "body"), ("n", "c\nd", 2, "body")]
    assert cut(spark, " \n\t\n") == [] and cut(spark, "") == []


# --- the engine


def test_engine_finds_bodies_and_impacts_of_many(spark, tmp_path):
    root = tmp_path / "shop"
    sources = {
        "grails-app/services/shop/StockService.groovy": "package shop\nclass StockService {\n  def reserve(item) {\n    def shelf = warehouse.pickPallet(item)\n    shelf.save()\n  }\n}\n",
        "grails-app/services/shop/OrderService.groovy": "package shop\nclass OrderService {\n  StockService stockService\n  def place(order) {\n    stockService.reserve(order)\n  }\n}\n",
    }
    for name, content in sources.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    engine = Engine(spark, str(tmp_path / "store"))
    pid = engine.index(str(root))["project_id"]
    bodies = engine.store.read("chunks", pid).filter("chunk_type = 'body'").collect()
    assert any("pickPallet" in r["text"] and "StockService" in r["symbol_id"] for r in bodies)
    asked = spark.createDataFrame([("q1", "def shelf = warehouse pickPallet item"), ("q2", "stockService reserve order")], "query_id string, text string")
    best = {r["query_id"]: r for r in engine.ask_many(pid, asked, 1).collect()}
    assert "pickPallet" in best["q1"]["text"] and "stockService.reserve" in best["q2"]["text"]
    symbols = engine._graph(pid)[0].select("id")
    many = {(r["seed"], r["id"], r["depth"]) for r in engine.impact(pid, symbols).collect()}
    assert any(d > 0 for _, _, d in many)
    for r in symbols.collect():
        assert {(r["id"], p["id"], p["depth"]) for p in engine.change_plan(pid, r["id"]).collect()} == {m for m in many if m[0] == r["id"]}
