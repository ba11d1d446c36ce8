"""Chunks, embeddings, exact vector search, question planning and context packs."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import entities, intent
from terrane.operators.templates import run_template, traverse

# The templates of each intent, in order.
INTENT_TEMPLATES = {
    "Location": ["find_symbol", "file_symbols"],
    "Logic": ["find_symbol", "callees_of", "renders_view"],
    "Impact": ["callers_of", "injected_into", "domain_relations"],
    "Trace": ["controller_flow", "callers_of", "callees_of", "renders_view"],
    "Relation": ["injects", "renders_view", "domain_relations", "controller_flow"],
    "Discovery": ["find_symbol"],
}
# Most templates, nodes, edges and chunks of a context pack; characters of a chunk of a view.
MOST_TEMPLATES, MOST_NODES, MOST_EDGES, MOST_CHUNKS, VIEW_CHARS = 5, 50, 200, 50, 2000
#: Kinds of symbols whose source lines are chunks, and of how many ends of statements one ends a chunk.
BODY_KINDS, CUT_ONE_IN = ("method", "constructor", "action"), 8


def chunks(symbols: DataFrame, static_text: str = "static_text") -> DataFrame:
    """chunk_id, symbol_id, chunk_type, text and the symbol's place: a docstring chunk and, for views, consecutive ones of their whole text."""
    text = F.try_element_at("properties", F.lit(static_text))
    both = F.array(
        F.when(F.trim("docstring") != "", F.struct(F.lit("docstring").alias("chunk_type"), F.col("docstring").alias("text"))),
    )
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / VIEW_CHARS).cast("int"))
    parts = F.transform(starts, lambda i: F.struct(F.lit("gsp_text").alias("chunk_type"), F.substring(text, i * VIEW_CHARS + 1, F.lit(VIEW_CHARS)).alias("text")))
    views = F.when(F.col("kind").startswith("gsp_") & (text != ""), parts).otherwise(F.expr("cast(array() as array<struct<chunk_type:string,text:string>>)"))
    every = F.concat(F.filter(both, lambda c: c.isNotNull()), views)
    out = symbols.select(F.col("id").alias("symbol_id"), "project_id", "kind", "file_path", "line_start", F.posexplode(every).alias("nth", "c"))
    return out.select(F.concat_ws("_", "symbol_id", "nth").alias("chunk_id"), "symbol_id", "c.chunk_type", "c.text", "project_id", "kind", "file_path", "line_start")


def body_chunks(symbols: DataFrame, files: DataFrame, kinds: tuple[str, ...] = BODY_KINDS) -> DataFrame:
    """The columns of `chunks` for the source of methods: consecutive lines of the symbols' files (path, text), whole, as chunk_type body.

    A chunk ends after a line that ends a statement (`;`, `{`, `}` or a blank line) if the hash of the trimmed line says so, one
    in CUT_ONE_IN. So cuts depend on the lines alone, and an inserted or changed line touches its own chunk and at most the next. A
    chunk's id has the symbol, the hash of its text and how many equal ones of the symbol stand before it, no position. A file is
    joined once with all ranges of its symbols and cut in its row. Symbols without lines or file have no chunks; chunks of
    white space only go, NULs and carriage returns at ends of lines too.
    """
    ranges = symbols.filter(F.col("kind").isin(*kinds) & (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")))
    ranges = ranges.select(F.col("id").alias("symbol_id"), "project_id", "kind", "file_path", F.col("line_start").cast("int"), F.col("line_end").cast("int"))
    held = files.select("project_id", F.col("path").alias("file_path"), F.split(F.replace("text", F.lit("\0"), F.lit("")), "\r?\n", -1).alias("lines"))
    of_file = ranges.groupBy("project_id", "file_path").agg(F.collect_list(F.struct("symbol_id", "kind", "line_start", "line_end")).alias("ranges"))
    one_of = F.array(*[F.lit(f"{h:02x}") for h in range(256 // CUT_ONE_IN)])

    def marked(line: Column, i: Column) -> Column:
        """A line that ends a chunk carries the number of the one after it, behind a NUL."""
        said = F.trim(line)
        ends = (F.right(said, F.lit(1)).isin(";", "{", "}") | (said == "")) & F.array_contains(one_of, F.substring(F.sha2(said, 256), 1, 2))
        return F.when(ends, F.concat(line, F.lit("\0"), (i + 1).cast("string"))).otherwise(line)

    def body(r: Column) -> Column:
        lines = F.slice("lines", r["line_start"], r["line_end"] - r["line_start"] + 1)
        texts = F.split(F.concat(F.lit("0\n"), F.array_join(F.transform(lines, marked), "\n")), "\0", -1)
        return F.struct(*[r[c].alias(c) for c in ("symbol_id", "kind", "line_start")], texts.alias("texts"))

    cuts = held.join(of_file, ["project_id", "file_path"]).select("project_id", "file_path", F.explode(F.transform("ranges", body)).alias("b"))
    cuts = cuts.select("b.symbol_id", "project_id", "b.kind", "file_path", "b.line_start", F.explode("b.texts").alias("piece"))
    at = F.locate("\n", "piece")
    text, first = F.expr("substring(piece, locate('\n', piece) + 1)"), F.col("line_start") + F.substring_index("piece", "\n", 1).cast("long")
    out = cuts.filter(at > 0).withColumns({"text": text, "line_start": first}).filter(F.trim(F.translate("text", "\t\r\n", "   ")) != "")
    same = F.row_number().over(Window.partitionBy("symbol_id", "project_id", "file_path", "text").orderBy("line_start")) - 1
    out = out.withColumn("chunk_id", F.concat_ws("_", "symbol_id", F.substring(F.sha2("text", 256), 1, 16), same))
    return out.select("chunk_id", "symbol_id", F.lit("body").alias("chunk_type"), "text", "project_id", "kind", "file_path", "line_start")


def hashed_vectors(texts: list[str | None], width: int = 384) -> np.ndarray:
    """The offline backend: signed hashed word counts of unit length; a text without words has a constant vector."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            row[h % width] += 1 if h >> 16 & 1 else -1
        row += 1e-6
        row /= np.linalg.norm(row)
    return out


def embed(text: Column, backend=hashed_vectors, width: int = 384) -> Column:
    @F.pandas_udf("array<float>")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series(list(backend(batch.tolist(), width)))

    return of(text)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, id: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest by squared distance, ties to the smaller id: one scan and a TakeOrderedAndProject."""
    rows = vectors if where is None else vectors.filter(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", squared_distance(F.col(embedding), target)).orderBy("distance", id).limit(k)


def routed(questions: DataFrame, text: str = "text") -> DataFrame:
    """Many questions in one job: intent and entities as columns."""
    return questions.withColumn("intent", intent(F.col(text))).withColumn("entities", entities(F.col(text)))


def plan(question: str, symbols: DataFrame, edges: DataFrame, project_id: str, vectors: DataFrame | None = None, max_depth: int = 3, backend=hashed_vectors) -> dict:
    """intent, entities, templates and three bounded DataFrames: nodes, edges, chunks."""
    spark = symbols.sparkSession
    row = spark.range(1).select(intent(F.lit(question)).alias("intent"), entities(F.lit(question)).alias("e")).first()
    names = row["e"]["symbol_names"]
    q = next((n for n in names if re.search(r"[a-z][A-Z]", n)), names[-1] if names else question)
    anchor = run_template("find_symbol", symbols, edges, pid=project_id, q=q, limit=1).select("id").head()
    templates, found = INTENT_TEMPLATES[row["intent"]][:MOST_TEMPLATES], []
    for order, name in enumerate(templates):
        if name == "find_symbol":
            arguments = {"pid": project_id, "q": q}
        elif name == "file_symbols":
            arguments = {"pid": project_id, "fp": (row["e"]["file_paths"] or [q])[0]}
        elif anchor:
            arguments = {"id": anchor["id"]}
        else:
            continue
        found.append(run_template(name, symbols, edges, **arguments).withColumn("_order", F.lit(order)))
    if anchor and row["intent"] in ("Impact", "Trace"):
        reached = traverse(edges, spark.createDataFrame([(anchor["id"],)], "id string"), depth=max_depth, reverse=row["intent"] == "Impact")
        found.append(symbols.join(reached.select("id"), "id", "left_semi").select(symbols.columns).withColumn("_order", F.lit(len(templates))))
    nodes = symbols.filter("false").withColumn("_order", F.lit(0))  # a question about no known symbol finds nothing
    for other in found:
        nodes = nodes.unionByName(other)
    first = Window.partitionBy("id").orderBy("_order")
    nodes = nodes.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").orderBy("_order", "id").limit(MOST_NODES).drop("_nth", "_order")
    ids = nodes.select("id")
    near = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(edges.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(edges.columns)).distinct()
    out = {"intent": row["intent"], "entities": row["e"].asDict(), "templates": templates, "nodes": nodes, "edges": near.orderBy("source_id", "type", "target_id").limit(MOST_EDGES)}
    if vectors is not None:
        out["chunks"] = search(vectors.filter(F.col("project_id") == project_id), backend([question])[0].tolist(), 10).limit(MOST_CHUNKS)
    return out
