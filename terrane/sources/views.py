"""GSP and JSP pages as nodes and edges, with regular expressions inside Catalyst only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import line_of


def attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?s)(?<![\w:-]){name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(found != "", found)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tags(text: Column, prefixes: str = "g|f") -> Column:
    """array<struct<name, tag, line>> of opening tags with one of the prefixes; every repeat of a tag has the first one's line."""
    each = lambda t: F.struct(F.regexp_extract(t, r"^<([\w]+:[\w.]+)", 1).alias("name"), t.alias("tag"), line_of(text, t).alias("line"))
    return F.transform(_all(text, rf"(?s)<(?:{prefixes}):[\w.]+[^>]*>"), each)


def static_text(text: Column) -> Column:
    """What is left of the whole page without scripts, code, expressions and tags, white space squeezed."""
    bare = F.regexp_replace(text, r"(?s)<%.*?%>|<(script|style)\b.*?</\1>|\$\{[^}]*\}|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def model_variables(text: Column) -> Column:
    return F.array_distinct(_all(text, r"\$\{\s*([A-Za-z_]\w*)", 1))


def parse_gsp(files: DataFrame, text: str = "text") -> DataFrame:
    """files with layout, tags, includes (template, else page, else view), taglibs, static_text, scriptlets, expressions, el, model_variables."""
    t = F.col(text)
    layout = F.regexp_extract(t, r"(?is)<meta\s+[^>]*name\s*=\s*[\"']layout[\"'][^>]*content\s*=\s*[\"']([^\"']+)[\"']", 1)
    target = lambda x: F.coalesce(attribute(x["tag"], "template"), attribute(x["tag"], "page"), attribute(x["tag"], "view"))
    named = lambda x: x["name"].isin("g:render", "g:include")
    return files.withColumns({
        "layout": F.when(layout != "", layout), "tags": tags(t), "taglibs": _all(t, r"(?s)<%@\s*taglib\b[^%]*uri\s*=\s*[\"']([^\"']+)[\"']", 1), "static_text": static_text(t),
        "scriptlets": _all(t, r"(?s)<%(?![@=!-])(.*?)%>", 1), "expressions": _all(t, r"(?s)<%=(.*?)%>", 1), "el": _all(t, r"\$\{([^}]*)\}", 1), "model_variables": model_variables(t),
    }).withColumn("includes", F.filter(F.transform(F.filter("tags", named), lambda x: F.struct(target(x).alias("target"), x["line"].alias("line"))), lambda x: x["target"].isNotNull()))


def gsp_links(parsed: DataFrame) -> DataFrame:
    """A row for each g:link with any of action, controller, mapping, uri and id."""
    keys = ("action", "controller", "mapping", "uri", "id")
    rows = parsed.select("project_id", "path", F.explode(F.filter("tags", lambda x: x["name"] == "g:link")).alias("t"))
    rows = rows.select("project_id", "path", "t.line", *[attribute(F.col("t.tag"), k).alias(k) for k in keys])
    return rows.filter(F.coalesce(*keys).isNotNull())


def parse_jsp(files: DataFrame, text: str = "text") -> DataFrame:
    """files with actions, directives, includes, forwards, taglibs, scriptlets, expressions, el, static_text."""
    t = F.col(text)
    page = lambda what: F.transform(_all(t, rf"(?s)<jsp:{what}\b[^>]*>"), lambda x: F.struct(attribute(x, "page").alias("target"), line_of(t, x).alias("line")))
    directive = lambda what, key: F.transform(_all(t, rf"(?s)<%@\s*{what}\b.*?%>"), lambda x: F.struct(attribute(x, key).alias("target"), line_of(t, x).alias("line"), F.coalesce(attribute(x, "prefix"), F.lit("")).alias("prefix")))
    kept = lambda rows: F.filter(rows, lambda x: x["target"].isNotNull())
    return files.withColumns({
        "actions": tags(t, "jsp"), "directives": _all(t, r"(?s)<%@\s*(\w+)", 1), "includes": kept(F.concat(page("include"), F.transform(directive("include", "file"), lambda x: F.struct(x["target"].alias("target"), x["line"].alias("line"))))), "forwards": kept(page("forward")),
        "taglibs": kept(directive("taglib", "uri")), "scriptlets": _all(t, r"(?s)<%(?![@=!-])(.*?)%>", 1), "expressions": _all(t, r"(?s)<%=(.*?)%>", 1), "el": _all(t, r"\$\{([^}]*)\}", 1), "static_text": static_text(t),
    })


def view_symbols(parsed: DataFrame, kind: Column, tag: str) -> DataFrame:
    """One symbol for each page."""
    name = F.substring_index("path", "/", -1)
    shown = F.create_map(F.lit("static_text"), F.col("static_text"), F.lit("el"), F.to_json("el"))
    return parsed.select(
        F.concat_ws(":", "project_id", F.lit(tag), "path").alias("id"), kind.alias("kind"), name.alias("name"), F.col("path").alias("fqn"), F.col("path").alias("file_path"), F.lit(1).cast("long").alias("line_start"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_end"), F.lit(tag).alias("language"), "project_id", F.lit("").alias("docstring"), F.col("content_hash").alias("source_hash"), shown.alias("properties"),
    )


def _edges(parsed: DataFrame, tag: str, rows: Column, kind: str, hint: Column) -> DataFrame:
    """One edge for each element `x` of an array; the hint is a column of x."""
    out = parsed.select("project_id", "path", F.explode(rows).alias("x"))
    return out.select(
        F.concat_ws(":", "project_id", F.lit(tag), "path").alias("source_id"), F.lit(None).cast("string").alias("target_id"), hint.alias("target_hint"), F.lit(kind).alias("type"), F.col("path").alias("file_path"), F.col("x.line").alias("line"),
        F.lit("UNRESOLVED").alias("confidence"), F.lit(f"{tag}_extractor").alias("extractor"), "project_id",
    )


def gsp_edges(parsed: DataFrame) -> DataFrame:
    layout = F.filter(F.array(F.struct(F.col("layout").alias("target"), F.lit(1).cast("long").alias("line"))), lambda x: x["target"].isNotNull())
    hinted = lambda key: F.concat(F.lit(f"{key}:"), F.col("x.target"))
    link = F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), attribute(F.col("x.tag"), k)) for k in ("action", "controller", "mapping", "uri")])
    out = _edges(parsed, "gsp", layout, "USES_LAYOUT", hinted("layout"))
    out = out.unionByName(_edges(parsed, "gsp", F.col("includes"), "INCLUDES_TEMPLATE", hinted("template")))
    out = out.unionByName(_edges(parsed, "gsp", F.col("tags"), "USES_TAG", F.concat(F.lit("tag:"), F.col("x.name"))))
    return out.unionByName(_edges(parsed, "gsp", F.filter("tags", lambda x: x["name"] == "g:link"), "LINKS_TO", link).filter("target_hint <> ''"))


def jsp_edges(parsed: DataFrame) -> DataFrame:
    hinted = lambda key: F.concat(F.lit(f"{key}:"), F.col("x.target"))
    out = _edges(parsed, "jsp", F.col("includes"), "JSP_INCLUDES", hinted("include"))
    out = out.unionByName(_edges(parsed, "jsp", F.col("forwards"), "JSP_FORWARDS", hinted("forward")))
    return out.unionByName(_edges(parsed, "jsp", F.col("taglibs"), "USES_TAGLIB", F.concat_ws(":", F.lit("taglib"), "x.prefix", "x.target")))
