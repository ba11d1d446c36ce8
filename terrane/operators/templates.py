"""Named graph queries. Each takes (symbols, edges, **arguments) and returns symbols, ordered by id, at most its limit."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hop(symbols: DataFrame, edges: DataFrame, id: str, types: tuple[str, ...], at: str = "source_id", limit: int | None = None) -> DataFrame:
    """Symbols on the other end of edges of the types at an id."""
    other = "target_id" if at == "source_id" else "source_id"
    ends = edges.filter(F.col("type").isin(*types) & (F.col(at) == id)).select(F.col(other).alias("id")).distinct()
    out = symbols.join(ends, "id", "left_semi").orderBy("id")
    return out if limit is None else out.limit(limit)


def find_symbol(symbols: DataFrame, edges: DataFrame, pid: str, q: str, limit: int = 20) -> DataFrame:
    return symbols.filter((F.col("project_id") == pid) & (F.col("fqn").contains(q) | (F.col("name") == q))).orderBy("id").limit(limit)


def file_symbols(symbols: DataFrame, edges: DataFrame, pid: str, fp: str) -> DataFrame:
    return symbols.filter((F.col("project_id") == pid) & (F.col("file_path") == fp)).orderBy("id")


def domain_relations(symbols: DataFrame, edges: DataFrame, id: str) -> DataFrame:
    both = _hop(symbols, edges, id, ("HAS_RELATION",)).union(_hop(symbols, edges, id, ("HAS_RELATION",), "target_id"))
    return both.dropDuplicates(["id"]).orderBy("id")


def controller_flow(symbols: DataFrame, edges: DataFrame, id: str) -> DataFrame:
    """What the declared members of a symbol render, redirect to or call."""
    members = edges.filter((F.col("type") == "DECLARES") & (F.col("source_id") == id)).select(F.col("target_id").alias("source_id"))
    ends = edges.filter(F.col("type").isin("RENDERS", "REDIRECTS_TO", "CALLS")).join(members, "source_id", "left_semi")
    return symbols.join(ends.select(F.col("target_id").alias("id")), "id", "left_semi").orderBy("id")


def missing_views(symbols: DataFrame, edges: DataFrame, pid: str) -> DataFrame:
    """Unlike the others, edges."""
    return edges.filter((F.col("project_id") == pid) & (F.col("type") == "RENDERS") & (F.col("confidence") == "UNRESOLVED"))


def followed(name: str, edges: DataFrame, id: str) -> DataFrame:
    """The edges that a one-hop template follows from an id, both ends included."""
    if name == "domain_relations":
        return edges.filter((F.col("type") == "HAS_RELATION") & ((F.col("source_id") == id) | (F.col("target_id") == id)))
    how = TEMPLATES[name]
    if not isinstance(how, partial):
        raise ValueError(f"{name} follows no single kind of edge")
    return edges.filter(F.col("type").isin(*how.keywords["types"]) & (F.col(how.keywords.get("at", "source_id")) == id))


TEMPLATES: dict[str, Callable[..., DataFrame]] = {
    "find_symbol": find_symbol,
    "callers_of": partial(_hop, types=("CALLS",), at="target_id", limit=50),
    "callees_of": partial(_hop, types=("CALLS",), limit=50),
    "file_symbols": file_symbols,
    "injects": partial(_hop, types=("INJECTS",)),
    "injected_into": partial(_hop, types=("INJECTS",), at="target_id"),
    "extends": partial(_hop, types=("EXTENDS",)),
    "implements": partial(_hop, types=("IMPLEMENTS",)),
    "declares": partial(_hop, types=("DECLARES",)),
    "renders_view": partial(_hop, types=("RENDERS",)),
    "domain_relations": domain_relations,
    "controller_flow": controller_flow,
    "missing_views": missing_views,
}


def run_template(name: str, symbols: DataFrame, edges: DataFrame, **arguments) -> DataFrame:
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}; known: {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name](symbols, edges, **arguments)


def traverse(edges: DataFrame, seeds: DataFrame, types: tuple[str, ...] = (), depth: int = 3, reverse: bool = False) -> DataFrame:
    """id, depth: what is reached from the seeds (id) in at most `depth` hops, at its smallest depth; cycles end.

    A level is one semi join of the edges with the frontier; equal subplans share their exchanges. Where the session has a
    checkpoint folder, a level is cut off there and leaves out what was visited before.
    """
    steps = edges.filter(F.col("type").isin(*types)) if types else edges
    near, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    steps = steps.filter(F.col(far).isNotNull()).select(F.col(near).alias("id"), F.col(far).alias("next"))
    visited = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, cut = visited.select("id"), edges.sparkSession.sparkContext.getCheckpointDir() is not None
    for level in range(1, depth + 1):
        frontier = steps.join(frontier, "id", "left_semi").select(F.col("next").alias("id")).distinct()
        if cut:
            frontier = frontier.join(visited.select("id"), "id", "left_anti").checkpoint()
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(level)))
    return visited.groupBy("id").agg(F.min("depth").alias("depth"))
