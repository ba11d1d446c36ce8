"""A knowledge-graph view of the driver's tables, so that the graph operators have rows to work on.

symbols: regions, nations, customers, suppliers, parts and orders. edges: region DECLARES nation; customer and supplier
INJECTS nation; order CALLS customer; order USES_TYPE part and RENDERS supplier (distinct pairs of lineitem);
nation HAS_RELATION region.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "demo"
# kind: table, key, name
KINDS = {"region": ("region", "r_regionkey", "r_name"), "nation": ("nation", "n_nationkey", "n_name"), "customer": ("customer", "c_custkey", "c_name"), "supplier": ("supplier", "s_suppkey", "s_name"), "part": ("part", "p_partkey", "p_name"), "order": ("orders", "o_orderkey", "concat('Order#', o_orderkey)")}
# type, table, source kind and key, target kind and key, distinct
LINKS = [
    ("DECLARES", "nation", "region", "n_regionkey", "nation", "n_nationkey", False),
    ("INJECTS", "customer", "customer", "c_custkey", "nation", "c_nationkey", False),
    ("INJECTS", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey", False),
    ("CALLS", "orders", "order", "o_orderkey", "customer", "o_custkey", False),
    ("USES_TYPE", "lineitem", "order", "l_orderkey", "part", "l_partkey", True),
    ("RENDERS", "lineitem", "order", "l_orderkey", "supplier", "l_suppkey", True),
    ("HAS_RELATION", "nation", "nation", "n_nationkey", "region", "n_regionkey", False),
]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [
        spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"concat('{kind}:', {key}) as id", f"'{kind}' as kind", f"{name} as name", f"concat('{kind}.', {name}) as fqn", f"'{table}' as file_path", f"cast({key} as bigint) as line_start", f"'{PROJECT}' as project_id")
        for kind, (table, key, name) in KINDS.items()
    ]
    return reduce(DataFrame.unionByName, each)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = []
    for kind, table, source, s, target, t, distinct in LINKS:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"concat('{source}:', {s}) as source_id", f"concat('{target}:', {t}) as target_id", f"'{table}' as file_path")
        each.append((rows.distinct() if distinct else rows).withColumns({"type": F.lit(kind), "confidence": F.lit("EXACT"), "project_id": F.lit(PROJECT)}))
    return reduce(DataFrame.unionByName, each)


def oracle_prelude() -> str:
    """The same two tables for DuckDB."""
    nodes = " UNION ALL ".join(f"SELECT concat('{kind}:', {key}) AS id, '{kind}' AS kind, {name} AS name, concat('{kind}.', {name}) AS fqn, '{table}' AS file_path, CAST({key} AS BIGINT) AS line_start, '{PROJECT}' AS project_id FROM {table}" for kind, (table, key, name) in KINDS.items())
    links = " UNION ALL ".join(f"SELECT {'DISTINCT ' if distinct else ''}concat('{source}:', {s}) AS source_id, concat('{target}:', {t}) AS target_id, '{table}' AS file_path, '{kind}' AS type, 'EXACT' AS confidence, '{PROJECT}' AS project_id FROM {table}" for kind, table, source, s, target, t, distinct in LINKS)
    return f"WITH RECURSIVE symbols AS ({nodes}), edges AS ({links})"
