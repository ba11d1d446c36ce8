"""Type environments: what type a name has at a line of a body.

Scopes are rows: a field is known in its whole type, a parameter in its method, a local variable from its declaration to
the end of its method. A call's receiver is joined with the scopes of its owner and name whose lines hold the call's; the
nearest one, which begins last, wins. So the join is an equality with a range, and what it finds is one row for each
receiver and line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import hint

#: `Type name`, also with type arguments, where a declaration can end; and `def name = new Type`.
LOCAL = r"(?:^|[({;,]|\bfinal\s|\s)\s*((?:[a-z]\w*\.)*[A-Z]\w*)(?:<[^;()=]*>)?(?:\[\])*\s+([a-z_]\w*)\s*(?==[^=]|[;:,)]|\bin\b|$)"
MADE = r"\b(?:def|var)\s+(\w+)\s*=\s*new\s+((?:[a-z]\w*\.)*[A-Z]\w*)"
SCOPE = ["project_id", "file_path", "owner", "source_id", "name", "type", "first_line", "last_line", "rank"]


def _plain(kind: Column) -> Column:
    """A type without its arguments and brackets."""
    return F.regexp_replace(F.substring_index(kind, "<", 1), r"[\[\]\s.]+$|^@?\w+\s+(?=\w)", "")


def scopes(declared: DataFrame, lines: DataFrame) -> DataFrame:
    """SCOPE rows of fields, parameters and locals. A field has no source_id: it is known to all of its owner."""
    at = lambda rows, source, name, kind, first, last, rank: rows.select("project_id", F.col("path").alias("file_path"), "owner", source.alias("source_id"), name.alias("name"), _plain(kind).alias("type"), first.cast("long").alias("first_line"), last.cast("long").alias("last_line"), F.lit(rank).alias("rank"))
    fields = declared.filter("what = 'field' and type <> ''")
    pairs = declared.filter("what <> 'type'").withColumn("p", F.explode(F.arrays_zip(F.col("param_names").alias("n"), F.col("param_types").alias("t")))).filter("p.t <> ''")
    typed, made = (F.regexp_extract_all("bare", F.lit(p), F.lit(g)) for p, g in ((LOCAL, 1), (MADE, 2)))
    names, called = (F.regexp_extract_all("bare", F.lit(p), F.lit(g)) for p, g in ((LOCAL, 2), (MADE, 1)))
    found = F.arrays_zip(F.concat(names, called).alias("n"), F.concat(typed, made).alias("t"))
    locals_ = lines.withColumn("p", F.explode(found))
    end = F.coalesce("end_line", F.lit(1 << 30))
    rows = [
        at(fields, F.lit(None).cast("string"), F.col("name"), F.col("type"), F.lit(0), F.lit(1 << 30), 0),
        at(pairs, F.col("id"), F.col("p.n"), F.col("p.t"), F.col("line"), end, 1),
        at(locals_, F.col("id"), F.col("p.n"), F.col("p.t"), F.col("at"), end, 2),
    ]
    known = reduce(DataFrame.unionByName, rows).filter(F.col("name").isNotNull() & F.col("type").rlike(r"^[\w.]*[A-Z]\w*$"))
    return known.select(SCOPE)


def typed_calls(edges: DataFrame, declared: DataFrame, lines: DataFrame) -> DataFrame:
    """edges, those that call something on a name of a known type with `declared:TYPE` added to their hint."""
    receiver = F.regexp_replace(hint(F.col("target_hint"), "receiver"), r"^this\.", "")
    on_field = hint(F.col("target_hint"), "receiver").startswith("this.")
    named = edges.withColumn("_name", F.when((F.col("type") == "CALLS") & receiver.rlike(r"^[a-z_]\w*$"), receiver)).withColumn("_field", F.coalesce(on_field, F.lit(False)))
    owners = declared.select(F.col("id").alias("source_id"), F.col("path").alias("file_path"), "owner").dropDuplicates(["source_id", "file_path"])
    key = ["source_id", "file_path", "line", "_name", "_field"]
    asked = named.filter(F.col("_name").isNotNull() & (F.col("_name") != "this")).select(*key).distinct().join(owners, ["source_id", "file_path"])
    s = scopes(declared, lines).withColumnsRenamed({"source_id": "_scope", "file_path": "_file", "owner": "_owner"}).drop("project_id")
    here = (F.col("file_path") == F.col("_file")) & (F.col("owner") == F.col("_owner")) & (F.col("_name") == F.col("name")) & F.col("line").between(F.col("first_line"), F.col("last_line"))
    inside = F.col("_scope").isNull() | ((F.col("_scope") == F.col("source_id")) & ~F.col("_field"))
    nearest = asked.join(s, here & inside).groupBy(*key).agg(F.max_by("type", F.struct("first_line", "rank", "type")).alias("_type"))
    out = named.join(nearest.withColumnsRenamed({k: f"n_{k}" for k in key}), reduce(Column.__and__, [F.col(k) == F.col(f"n_{k}") for k in key]), "left")
    return out.withColumn("target_hint", F.when(F.col("_type").isNotNull(), F.concat_ws("|", "target_hint", F.concat(F.lit("declared:"), "_type"))).otherwise(F.col("target_hint"))).select(edges.columns)
