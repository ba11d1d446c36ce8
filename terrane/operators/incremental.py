"""Incremental resolution: which edges a change of symbols concerns, from an inverted index of what edges ask for.

A symbol provides keys (its id, its simple names, its bean, the short name of its view, its layout, its uri), an edge
asks for keys (its two ends, and what its hint names). The resolution of an edge depends on the symbols of its keys
only. So the index, a table of (key, edge as it was extracted), is joined with the keys of the symbols that came, went or
changed; edges without such a key are not read. The index is stored in buckets by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import fqn_base, simple_name
from terrane.operators.routing import segments

#: What makes an extracted edge the same, and the columns it has before it is resolved.
IDENTITY = ["source_id", "type", "target_id", "target_hint", "file_path", "line"]
EXTRACTED = [*IDENTITY, "confidence", "extractor", "project_id"]
#: What resolution reads of a symbol.
READ = ["id", "kind", "name", "fqn", "file_path", "line_start", "properties"]

# The keys of hints, by what the value names.
NAMES = ("type", "class", "interface", "domain", "command", "method", "action", "receiver", "declared", "tag")
BEANS = ("qualifier", "service", "bean", "receiver")
VIEWS = ("view", "action", "template", "include", "forward")
URIS = ("uri", "mapping")


def _key(kind: str, value: Column) -> Column:
    """kind:value; null where there is no value."""
    return F.when(value != "", F.concat(F.lit(f"{kind}:"), value))


def _present(*keys: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _begin(uri: Column) -> Column:
    """A path's first segment; `$` for one that any URI may have, or that may be missing."""
    first = F.coalesce(F.get(segments(uri), F.lit(0)), F.lit("$"))
    return F.when(first.rlike(r"^[$*]"), "$").otherwise(first)


def symbol_keys(symbols: DataFrame) -> DataFrame:
    """key: of all symbols, once each."""
    last = F.substring_index(F.substring_index(F.substring_index(fqn_base(F.col("fqn")), "#", -1), ".", -1), "$", -1)
    bean = F.coalesce(F.try_element_at("properties", F.lit("bean_name")), F.when(F.col("kind") == "bean", F.col("name")))
    keys = _present(
        _key("id", F.col("id")), _key("name", simple_name(F.col("name"))), _key("name", last), _key("bean", bean),
        _key("view", F.regexp_extract("file_path", r"([^/]+)\.[a-z]+$", 1)), _key("view", F.regexp_extract("file_path", r"/_([^/]+)\.[a-z]+$", 1)), _key("tag", F.when(F.col("kind") == "custom_tag", F.col("fqn"))),
        F.when(F.col("kind").isin("action", "method"), F.lit("applied")), _key("layout", F.regexp_extract("file_path", r"layouts/(.+)\.gsp$", 1)),
        _key("uri", F.when(F.col("kind") == "url_mapping", F.col("name"))), _key("route", F.when(F.col("kind") == "url_mapping", _begin(F.col("fqn")))),
    )
    return symbols.select(F.explode(keys).alias("key")).distinct()


def edge_keys() -> Column:
    """array<string> of an extracted edge."""

    def of_part(part: Column) -> Column:
        name, value = F.substring_index(part, ":", 1), F.substring(part, F.instr(part, ":") + 1, F.length(part))
        is_in = lambda names: name.isin(*names)
        return F.array(
            _key("name", F.when(is_in(NAMES), F.substring_index(simple_name(value), "$", -1))), _key("name", F.when(is_in(NAMES), simple_name(value))), _key("bean", F.when(is_in(BEANS), value)),
            _key("view", F.when(is_in(VIEWS), F.substring_index(F.regexp_replace(F.substring_index(value, "/", -1), r"^_|\.[a-z]+$", ""), "/", -1))),
            _key("view", F.when(is_in(VIEWS), F.regexp_replace(F.substring_index(value, "/", -1), r"\.[a-z]+$", ""))), _key("tag", F.when(name == "tag", value)),
            _key("layout", F.when(name == "layout", value)), _key("uri", F.when(is_in(URIS), value)),
            _key("route", F.when(is_in(URIS), _begin(value))), F.when(is_in(URIS), F.lit("route:$")),
        )

    hinted = F.flatten(F.transform(F.split(F.coalesce("target_hint", F.lit("")), r"\|"), of_part))
    return F.array_distinct(F.array_compact(F.concat(F.array(_key("id", F.col("source_id")), _key("id", F.col("target_id")), F.when(F.col("type") == "APPLIES_TO", F.lit("applied"))), hinted)))


def origin() -> Column:
    """A name of an extracted edge, the same in every run."""
    return F.md5(F.to_json(F.struct(*IDENTITY), {"ignoreNullFields": "false"}))


def index_rows(extracted: DataFrame) -> DataFrame:
    """key, origin and the edge, for every key that an edge asks for."""
    return extracted.select(F.explode(edge_keys()).alias("key"), origin().alias("origin"), *EXTRACTED)


def changed_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols that are in one of the two only, by what resolution reads."""
    sides = [df.select(F.to_json(F.struct(*READ)).alias("_said"), *READ) for df in (before, after)]
    only = lambda a, b: a.join(b.select("_said").distinct(), "_said", "left_anti").select(*READ)
    return only(*sides).unionByName(only(*reversed(sides)))


def affected(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The edges, as extracted and with their origin, that ask for one of the keys; each once."""
    return index.join(keys.select("key").distinct(), "key", "left_semi").dropDuplicates(["origin"]).select("origin", *EXTRACTED)


def refreshed(resolved: DataFrame, again: DataFrame) -> DataFrame:
    """Resolved edges with those of `again` in place of the same origin's; an edge that came out the same keeps its run.

    Both are dealt out by origin once, and neither is read twice.
    """
    both = resolved.withColumn("_again", F.lit(False)).unionByName(again.select(resolved.columns).withColumn("_again", F.lit(True)))
    of_origin = Window.partitionBy("origin")
    was = F.min(F.when(~F.col("_again"), F.struct("target_id", "confidence", "last_run_id"))).over(of_origin)
    rows = both.withColumns({"_replaced": F.max("_again").over(of_origin), "_was": was}).filter(F.col("_again") | F.col("origin").isNull() | ~F.col("_replaced"))
    same = F.col("_again") & F.col("origin").isNotNull() & F.col("_was").isNotNull() & F.col("target_id").eqNullSafe(F.col("_was.target_id")) & (F.col("confidence") == F.col("_was.confidence"))
    return rows.withColumn("last_run_id", F.when(same, F.col("_was.last_run_id")).otherwise(F.col("last_run_id"))).select(resolved.columns)
