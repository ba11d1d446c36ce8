"""Configuration files: .properties natively; YAML, Groovy scripts and XML by small Arrow functions; keys, secrets, profiles, databases, beans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import is_secret, redacted
from terrane.sources.code import Scan

# Keys of a database setting, the first that is present counts.
DATABASE_KEYS = {
    "url": ["dataSource.url", "dataSource.dbcp.url", "spring.datasource.url", "jdbc.url", "database.url", "hibernate.connection.url"],
    "driver": ["dataSource.driverClassName", "dataSource.driver", "spring.datasource.driver-class-name", "jdbc.driver"],
    "username": ["dataSource.username", "dataSource.user", "spring.datasource.username", "jdbc.user"],
    "password": ["dataSource.password", "spring.datasource.password", "jdbc.password"],
    "dialect": ["hibernate.dialect", "dataSource.dialect"],
}


def properties(files: DataFrame, text: str = "text") -> DataFrame:
    """project_id, path, key, value, line: the last assignment of a key counts.

    Continued lines are joined first; # and ! begin comments; = , : or white space end a key.
    """
    joined = F.regexp_replace(F.col(text), r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t]*", "$1")
    lines = files.select("project_id", "path", F.posexplode(F.split(joined, r"\r?\n")).alias("line", "raw")).withColumn("raw", F.ltrim("raw"))
    kept = lines.filter((F.col("raw") != "") & ~F.col("raw").rlike("^[#!]"))
    pattern = r"(?s)^((?:[^\\=:\s]|\\.)+)(?:\s*[=:]\s*|\s+|$)(.*)$"
    parts = kept.select("project_id", "path", "line", unescaped(F.regexp_extract("raw", pattern, 1)).alias("key"), F.trim(unescaped(F.regexp_extract("raw", pattern, 2))).alias("value"))
    last = parts.groupBy("project_id", "path", "key").agg(F.max_by("value", "line").alias("value"), (F.max("line") + 1).cast("long").alias("line"))
    return last.filter("key <> ''")


def unescaped(value: Column) -> Column:
    """Backslash escapes: \\uXXXX, \\t, \\n, \\r, \\f and any other character for itself. Cuts at escapes and maps the pieces."""
    pieces = F.regexp_extract_all(value, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\.|[^\\]+|\\$"), F.lit(0))
    code = lambda p: F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE")
    one = lambda p: F.when(p.rlike(r"^\\u[0-9A-Fa-f]{4}$"), code(p)).when(p == "\\t", "\t").when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\f", "\f").when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)
    return F.when(F.contains(value, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(value)


def flattened(data, prefix: str = "") -> Iterator[tuple[str, str, str]]:
    """(dotted key, value, type): lists of scalars are comma-joined, other lists numbered, an empty one is []."""
    if isinstance(data, dict) and (data or not prefix):
        for k, v in data.items():
            yield from flattened(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(data, list) and any(isinstance(x, (dict, list)) for x in data):
        for i, v in enumerate(data):
            yield from flattened(v, f"{prefix}[{i}]")
    elif isinstance(data, list):
        yield prefix, ", ".join(map(str, data)) if data else "[]", "list"
    else:
        yield prefix, "" if data is None else str(data).lower() if isinstance(data, bool) else str(data), type(data).__name__


def yaml_keys(files: DataFrame, text: str = "text") -> DataFrame:
    """project_id, path, key, value, type. Later documents of a file win; a file that cannot be read has no keys."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for project, path, source in zip(pdf["project_id"], pdf["path"], pdf[text], strict=True):
                keys: dict[str, tuple[str, str]] = {}
                for part in re.split(r"(?m)^---\s*$", source or ""):
                    try:
                        data = yaml.safe_load(part)
                    except yaml.YAMLError:
                        continue
                    if isinstance(data, dict):
                        keys |= {k: (v, t) for k, v, t in flattened(data)}
                rows += [(project, path, k, v, t) for k, (v, t) in keys.items()]
            yield pd.DataFrame(rows, columns=["project_id", "path", "key", "value", "type"])

    return files.select("project_id", "path", text).mapInPandas(parse, "project_id string, path string, key string, value string, type string")


def json_keys(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """key, value of the top level of a JSON object column."""
    return rows.select(*keep, F.explode(F.from_json(F.col(json), "map<string,string>")).alias("key", "value"))


def profiles(keys: DataFrame) -> DataFrame:
    """project_id, path, profile: of spring.profiles (comma-separated) and on-profile."""
    named = keys.filter(F.col("key").rlike(r"(^|\.)spring\.profiles(\.active)?$|(^|\.)on-profile$"))
    return named.select("project_id", "path", F.explode(F.array_distinct(F.split("value", r"\s*,\s*"))).alias("profile")).filter("profile <> ''").distinct()


def database(keys: DataFrame) -> DataFrame:
    """project_id, path and the database settings, the password redacted."""
    held = keys.groupBy("project_id", "path").agg(F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias("m"))
    first = {name: F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in synonyms]) for name, synonyms in DATABASE_KEYS.items()}
    first["password"] = F.when(first["password"].isNotNull(), redacted(F.lit("password"), first["password"]))
    return held.select("project_id", "path", *[c.alias(n) for n, c in first.items()]).filter(F.coalesce(*DATABASE_KEYS).isNotNull())


def config_symbols(keys: DataFrame) -> DataFrame:
    """config_key symbols, one for each file and key, with redacted values; `type` is the value's type where the reader knows it."""
    kind = F.col("type") if "type" in keys.columns else F.lit("str")
    shown = F.create_map(
        F.lit("value"), redacted(F.col("key"), F.col("value")), F.lit("is_redacted"), is_secret(F.col("key")).cast("string"),
        F.lit("original_type"), kind,
    )
    language = F.when(F.col("path").rlike(r"\.ya?ml$"), "yaml").when(F.col("path").rlike(r"\.groovy$"), "groovy").otherwise("properties")
    one = F.lit(1).cast("long")
    return keys.select(
        F.concat_ws(":", "project_id", F.lit("config_key"), F.concat_ws("#", "path", "key")).alias("id"), F.lit("config_key").alias("kind"),
        F.substring_index("key", ".", -1).alias("name"), F.col("key").alias("fqn"), F.col("path").alias("file_path"), one.alias("line_start"), one.alias("line_end"),
        language.alias("language"), "project_id", F.lit("").alias("docstring"), F.lit("").alias("source_hash"), shown.alias("properties"),
    )


def groovy_entries(text: str | None, environment: str | None = None) -> Iterator[tuple[str, str, str]]:
    """(dotted key, value, type) of a configuration script: nested blocks and assignments. Of `environments`, the named one's entries only."""
    scan = Scan(text or "", soft=True)

    def within(lo: int, hi: int, prefix: str) -> Iterator[tuple[str, str, str]]:
        for begin, head_end, end in scan.pieces(lo, hi):
            head = scan.mask[begin:head_end]
            sign = head.find("=")
            if sign > 0 and re.fullmatch(r"\s*[\w.'\"]+\s*", head[:sign]):
                value = scan.code[begin + sign + 1 : end + (end > head_end)].strip().rstrip(";").strip()
                yield (f"{prefix}{scan.code[begin : begin + sign].strip().strip(chr(34) + chr(39))}", *groovy_value(value))
            elif end > head_end and (name := re.fullmatch(r"\s*([\w.'\"]+)\s*(?:=\s*)?", scan.code[begin:head_end])):
                inside = name.group(1).strip("\"'")
                if inside == "environments" and not prefix:
                    for b, h, e in scan.pieces(head_end + 1, end):
                        if e > h and scan.code[b:h].strip() == environment:
                            yield from within(h + 1, e, "")
                else:
                    yield from within(head_end + 1, end, f"{prefix}{inside}.")

    yield from within(0, len(scan.mask), "")


def groovy_value(value: str) -> tuple[str, str]:
    if re.fullmatch(r"\"(\\.|[^\"\\])*\"|'(\\.|[^'\\])*'", value, re.S):
        return value[1:-1], "str"
    if re.fullmatch(r"-?\d+", value):
        return value, "int"
    return value, "bool" if value in ("true", "false") else "list" if value.startswith("[") else "expression"


def groovy_keys(files: DataFrame, text: str = "text", environment: str | None = None) -> DataFrame:
    """project_id, path, key, value, type of Groovy configuration scripts; the last assignment of a key counts."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for project, path, source in zip(pdf["project_id"], pdf["path"], pdf[text], strict=True):
                rows += [(project, path, k, *v) for k, v in {k: (v, t) for k, v, t in groovy_entries(source, environment)}.items()]
            yield pd.DataFrame(rows, columns=["project_id", "path", "key", "value", "type"])

    return files.select("project_id", "path", text).mapInPandas(parse, "project_id string, path string, key string, value string, type string")


XML = (
    "project_id string, path string, root_tag string, namespaces map<string,string>, elements_count long, error string, "
    "beans array<struct<type:string,id:string,name:string,class:string,parent:string,abstract:boolean,singleton:boolean,lazy_init:boolean,init_method:string,destroy_method:string,scope:string,alias:string,"
    "properties:array<struct<name:string,ref:string,value:string>>,constructor_args:array<struct<name:string,ref:string,value:string,index:string,type:string>>>>"
)


def _bean(element) -> dict:
    """A bean or alias element as a row; attributes that are absent are empty."""
    of = lambda e, *names: {n.replace("-", "_"): e.get(n, "") for n in names}
    inner = lambda tag, *names: [of(e, *names) for e in element.iter() if e.tag.rsplit("}", 1)[-1] == tag]
    yes = lambda name, default: element.get(name, default).lower() == "true"
    return of(element, "id", "name", "class", "init-method", "destroy-method", "alias") | {
        "type": element.tag.rsplit("}", 1)[-1], "parent": element.get("parent-bean", "") or element.get("parent", ""), "scope": element.get("scope", "singleton"),
        "abstract": yes("abstract", "false"), "singleton": yes("singleton", "true"), "lazy_init": yes("lazy-init", "false"),
        "properties": inner("property", "name", "ref", "value"), "constructor_args": inner("constructor-arg", "name", "ref", "value", "index", "type"),
    }


def parse_xml(files: DataFrame, text: str = "text") -> DataFrame:
    """XML: root tag, namespaces ('default' is the one without prefix), elements, beans and aliases in the order they end; of what is not well-formed, what was read and the error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for project, path, source in zip(pdf["project_id"], pdf["path"], pdf[text], strict=True):
                row = {"project_id": project, "path": path, "root_tag": None, "namespaces": {}, "elements_count": 0, "error": None, "beans": []}
                reader = ElementTree.XMLPullParser(("start", "end", "start-ns"))
                try:
                    reader.feed((source or "").strip())
                    reader.close()
                except ElementTree.ParseError as error:
                    row["error"] = str(error)
                try:
                    for event, got in reader.read_events():
                        if event == "start-ns":
                            row["namespaces"].setdefault(got[0] or "default", got[1])
                            continue
                        row["elements_count"] += event == "end"
                        row["root_tag"] = row["root_tag"] or got.tag
                        if event == "end" and got.tag.rsplit("}", 1)[-1] in ("bean", "alias"):
                            row["beans"].append(_bean(got))
                except ElementTree.ParseError as error:
                    row["error"] = str(error)
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("project_id", "path", "root_tag", "namespaces", "elements_count", "error", "beans")])

    return files.select("project_id", "path", text).mapInPandas(parse, XML)


def xml_beans(parsed: DataFrame) -> DataFrame:
    """One row for each bean or alias of parsed files."""
    return parsed.select("project_id", "path", F.posexplode("beans").alias("nth", "b")).select("project_id", "path", "nth", "b.*")


def xpath_lookup(files: DataFrame, path: str, text: str = "text") -> DataFrame:
    """project_id, path, found: the texts or attribute values of an XPath; files that are not well-formed have none. Prefixes are part of the names."""
    fine = parse_xml(files, text).filter("error is null").select("project_id", "path")
    return files.join(fine, ["project_id", "path"], "left_semi").select("project_id", "path", F.expr(f"xpath({text}, {_quoted(path)})").alias("found"))


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bean_symbols(beans: DataFrame) -> DataFrame:
    """bean symbols of XML files, by id or else name; aliases are beans of their alias."""
    rows = _named_beans(beans)
    one = F.lit(1).cast("long")
    said = F.create_map(F.lit("bean_name"), F.col("bean"), F.lit("class_name"), F.col("class"), F.lit("scope"), F.col("scope"), F.lit("properties"), F.to_json("properties"), F.lit("constructor_args"), F.to_json("constructor_args"))
    return rows.select(
        F.concat_ws(":", "project_id", F.lit("bean"), "bean").alias("id"), F.lit("bean").alias("kind"), F.col("bean").alias("name"), F.coalesce(F.nullif("class", F.lit("")), "bean").alias("fqn"), F.col("path").alias("file_path"),
        one.alias("line_start"), one.alias("line_end"), F.lit("xml").alias("language"), "project_id", F.lit("").alias("docstring"), F.lit("").alias("source_hash"), said.alias("properties"),
    )


def bean_edges(beans: DataFrame) -> DataFrame:
    """PROVIDES edges from beans to their classes."""
    rows = _named_beans(beans).filter("class <> ''")
    return rows.select(
        F.concat_ws(":", "project_id", F.lit("bean"), "bean").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.concat(F.lit("class:"), "class").alias("target_hint"), F.lit("PROVIDES").alias("type"),
        F.col("path").alias("file_path"), F.lit(1).cast("long").alias("line"), F.lit("EXACT").alias("confidence"), F.lit("xml_beans").alias("extractor"), "project_id",
    )


def _named_beans(beans: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.when(F.col("type") == "alias", F.col("alias")).otherwise(F.col("id")), F.lit("")), F.nullif("name", F.lit("")))
    rows = beans.withColumn("bean", name).filter("bean is not null")
    return rows.groupBy("project_id", "bean").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("project_id", "bean")]), F.struct("path", "nth")).alias("b")).select("project_id", "bean", "b.*")
