"""URI routing: concrete URIs reach the most specific of many patterns by walking a trie of path segments.

The trie is rows: every prefix of a pattern is a node, `$name` and `*` are one segment each whatever their name, `$name?`
may be missing, `**` takes all that follows. URIs walk it level by level, by a join on (node, step) for each of the steps that
their next segment allows; a URI is at several nodes at once. Levels are as many as the longest pattern has
segments. Of the patterns that are reached, the first by segment counts: a literal before a variable before `**`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How specific a step is, by its place in the walk's key; an end is more than `**`, which may take nothing.
REST, VARIABLE, LITERAL, END = "0", "1", "2", "3"

#: A private-use character that stands for the mark of a segment that may be missing.
MAY = "\ue000"


def segments(uri: Column) -> Column:
    """The segments of a path, without query, fragment and empty ones."""
    return F.filter(F.split(F.regexp_extract(uri, r"^[^?#]*", 0), "/"), lambda s: s != "")


def _step(segment: Column) -> Column:
    return F.when(segment == "**", "**").when(segment.startswith("$") | (segment == "*"), "$").otherwise(segment)


def trie(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From pattern and id: steps (at, step, to) and ends (at, id), of equal patterns the least id. A pattern is a path, so others are left out."""
    raw = patterns.filter(F.col("pattern").startswith("/")).select("id", F.regexp_replace("pattern", r"\(?\.\$format\)?\??$", "").alias("pattern"))
    # $a? may be missing: the pattern ends before it too. What follows ** is not looked at.
    cut = raw.withColumn("raw", F.transform(segments(F.regexp_replace("pattern", r"\?(?=/|$)", MAY)), lambda s: F.regexp_replace(s, r"[{}]", "")))
    path = cut.select("id", F.transform("raw", lambda s: _step(F.regexp_replace(s, MAY, ""))).alias("path"), F.transform("raw", lambda s: s.endswith(MAY)).alias("may"))
    stop = F.array_position("path", "**").cast("int")
    path = path.select("id", F.when(stop > 0, F.slice("path", F.lit(1), stop)).otherwise(F.col("path")).alias("path"), "may")
    node = lambda n: F.concat_ws("/", F.slice("path", F.lit(1), n))
    steps = path.filter(F.size("path") > 0).select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"))
    steps = steps.select(node(F.col("n") - 1).alias("at"), F.element_at("path", F.col("n")).alias("step"), node(F.col("n")).alias("to")).distinct()
    lengths = F.filter(F.sequence(F.lit(0), F.size("path")), lambda n: (n == F.size("path")) | F.forall(F.slice("may", n + 1, F.greatest(F.size("path") - n, F.lit(0))), lambda m: m))
    ends = path.select("id", "path", F.explode(lengths).alias("n")).select(node(F.col("n")).alias("at"), "id").groupBy("at").agg(F.min("id").alias("id"))
    return steps, ends


def route(uris: DataFrame, patterns: DataFrame) -> DataFrame:
    """uri and id: of each distinct uri that a pattern fits, the most specific pattern's."""
    steps, ends = trie(patterns)
    depth = steps.agg(F.max(F.size(F.split("to", "/"))).alias("n")).first()["n"] or 0
    steps = steps.select(F.col("at").alias("_at"), F.col("step").alias("_step"), "to")
    state = uris.select("uri").distinct().select("uri", segments(F.col("uri")).alias("path"), F.lit("").alias("at"), F.lit("").alias("how"), F.lit(False).alias("done"))
    go = lambda key, how, done: F.struct(key.alias("key"), F.lit(how).alias("how"), F.lit(done).alias("done"))
    stay = F.lit(None).cast("string")
    for level in range(depth + 1):
        segment = F.get("path", F.lit(level))
        ways = (
            F.when(F.col("done"), F.array(go(stay, "", True)))
            .when(F.size("path") == level, F.array(go(stay, END, True), go(F.lit("**"), REST, True)))
            .otherwise(F.array(go(F.when(~segment.isin("$", "**"), segment), LITERAL, False), go(F.lit("$"), VARIABLE, False), go(F.lit("**"), REST, True)))
        )
        # Each level is one join, and what has arrived travels along, so the walk's plan grows with the levels and no more.
        tried = state.select("uri", "path", "at", "how", F.explode(ways).alias("go")).filter("go.key is not null or go.done")
        state = tried.join(steps, (F.col("at") == F.col("_at")) & (F.col("go.key") == F.col("_step")), "left").filter("go.key is null or to is not null")
        state = state.select("uri", "path", F.coalesce("to", "at").alias("at"), F.concat("how", "go.how").alias("how"), "go.done")
    found = state.filter("done").select("uri", "at", "how")
    best = F.max_by("id", F.struct("how", "id"))
    return found.join(ends, "at").groupBy("uri").agg(best.alias("id"))
