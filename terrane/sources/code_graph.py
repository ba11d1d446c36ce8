"""Symbols and edges of Java and Groovy source: explodes and column expressions over declarations and their lines.

A body is read statement by statement, so every edge has its own line; what a statement holds is gathered in one array
and inlined once. A statement that stretches over lines within brackets has its first line's number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.paths import kind_of
from terrane.functions.text import line_of

# Annotations and type suffixes that mark an injected field, by language.
INJECTING = {"java": ["@Autowired", "@Inject", "@Resource", "@Value", "@Qualifier"], "groovy": ["@Autowired", "@Inject", "@Resource"]}
INJECTED = {"java": ["Service", "Repository", "Dao", "Manager", "Component", "Controller", "Factory"], "groovy": ["Service", "Repository", "Dao", "Manager", "Component"]}
# Members of a controller that are no actions.
NO_ACTIONS = ["init", "destroy", "allowedMethods"]
# The id's tag of types by artifact; others have their keyword.
TYPE_TAGS = {
    "grails_controller": "controller", "grails_service": "service", "grails_domain": "domain", "grails_taglib": "taglib", "grails_job": "job", "grails_interceptor": "interceptor", "grails_bootstrap": "bootstrap",
}
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "super", "this", "synchronized", "assert", "throw", "try", "else", "in", "new"]
QUERIES = r"\b([A-Z]\w*)\.(?:get|getAll|read|load|list|count|exists|find|findAll|where|withCriteria|createCriteria|executeQuery|(?:find|findAll|count|list)By\w+|listOrderBy\w+)\b"
FOUND = "array<struct<type:string,hint:string,confidence:string>>"
c = F.col


def _got(text: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's first match, else null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _ends(column: Column, suffixes: list[str]) -> Column:
    return column.rlike("(" + "|".join(suffixes) + ")$")


def _id(*parts) -> Column:
    return F.concat_ws(":", "project_id", *parts)


def described(declared: DataFrame) -> DataFrame:
    """Declarations with role, fqn, id, owner_id and the static fields of their type (statics)."""
    is_type = c("what") == "type"
    keyword = F.when(c("keyword") == "trait", "interface").otherwise(c("keyword"))
    pairs = F.create_map(*[F.lit(x) for item in TYPE_TAGS.items() for x in item])
    tag = F.coalesce(F.try_element_at(pairs, c("artifact_type")), keyword)
    closure = (c("what") == "field") & c("body").isNotNull() & ~F.array_contains("modifiers", "static")
    callable_ = (c("what") == "method") | closure
    role = (
        F.when(is_type, F.when(tag == keyword, keyword).otherwise(kind_of(c("artifact_type"))))
        .when(callable_ & (c("artifact_type") == "grails_controller") & ~c("name").startswith("_") & ~c("name").isin(NO_ACTIONS), "action")
        .when(callable_ & (c("artifact_type") == "grails_taglib"), "custom_tag").when(c("what") == "method", "method").otherwise(c("what"))
    )
    statics = declared.filter((c("what") == "field") & F.array_contains("modifiers", "static")).groupBy("project_id", "path", "owner").agg(F.collect_list(F.struct("name", "value")).alias("statics"))
    methods = declared.filter((c("what") == "method") | closure).groupBy("project_id", "path", "owner").agg(F.collect_set("name").alias("methods"))
    whole = declared.join(statics, ["project_id", "path", "owner"], "left").join(methods, ["project_id", "path", "owner"], "left").withColumn("role", role).withColumn("type_tag", tag)
    space = F.coalesce(_got(_static("namespace"), r"[\"'](\w+)[\"']"), F.lit("g"))
    short = c("artifact_type").isin("grails_controller", "grails_service") | (c("what") == "field")
    signature = F.concat(c("name"), F.lit("("), F.concat_ws(",", "param_types"), F.lit(")"))
    fqn = F.when(is_type, c("owner")).when(c("role") == "custom_tag", F.concat_ws(":", space, "name")).otherwise(F.concat_ws("#", "owner", F.when(short, c("name")).otherwise(signature)))
    whole = whole.withColumns({"fqn": fqn, "namespace": space, "owner_id": _id("type_tag", "owner")})
    return whole.withColumn("id", F.when(is_type, c("owner_id")).otherwise(_id("role", "fqn")))


def _static(name: str) -> Column:
    """The value of a type's static field, else null."""
    return F.try_element_at(F.filter("statics", lambda s: s["name"] == name), F.lit(1))["value"]


def _marked(names: list[str]) -> Callable[[Column], Column]:
    return lambda a: a.rlike("^(" + "|".join(names) + ")")


def injected() -> Column:
    """Whether a declaration is an injected field."""
    chain = F.lit(False)
    for language in INJECTING:
        noted = F.size(F.filter("annotations", _marked(INJECTING[language]))) > 0
        chain = F.when(c("language") == language, noted | _ends(c("type"), INJECTED[language])).otherwise(chain)
    return (c("what") == "field") & F.coalesce(chain, F.lit(False))


def code_symbols(d: DataFrame, by_file: bool = False) -> DataFrame:
    """One symbol for each declaration; of overloads with one id, the first (of each file). Properties without a value are left out."""
    is_type, grails = c("what") == "type", lambda kind: (c("what") == "type") & (c("artifact_type") == kind)
    visible = F.coalesce(F.try_element_at(F.filter("modifiers", lambda m: m.isin("public", "protected", "private")), F.lit(1)), F.when(c("language") == "java", F.lit("package-private")).otherwise(F.lit("public")))
    bean = F.regexp_replace("name", "Service$", "")
    yes = lambda condition: F.when(F.coalesce(condition, F.lit(False)), "true").otherwise("false")
    said = {
        "visibility": visible, "is_static": yes(F.array_contains("modifiers", "static")), "is_final": yes(F.array_contains("modifiers", "final")), "is_abstract": yes(F.array_contains("modifiers", "abstract")),
        "annotations": F.when(F.size("annotations") > 0, F.to_json("annotations")), "type_hint": F.when(c("what") == "field", c("type")), "type": F.when(injected(), c("type")), "injection_point": F.when(c("what") == "field", yes(injected())),
        "qualifier_hint": qualifier(), "return_type": F.when(c("what") == "method", c("type")), "params": F.when(c("body").isNotNull(), F.to_json("param_names")),
        "imports": F.when(is_type, F.concat_ws(",", "imports")), "bean_name": F.when(grails("grails_service"), F.concat(F.lower(F.left(bean, F.lit(1))), F.substring(bean, 2, 1 << 30), F.lit("Service"))),
        "transactional": F.when(grails("grails_service"), yes(F.exists("annotations", lambda a: a.startswith("@Transactional")) | (_static("transactional") == "true"))),
        "allowed_methods": F.when(grails("grails_controller"), _static("allowedMethods")), "table_name": F.when(grails("grails_domain"), _got(_static("mapping"), r"\btable\s*:?\s*\(?[\"'](\w+)")),
        "constraints": F.when(grails("grails_domain"), _static("constraints")), "has_many": F.when(grails("grails_domain"), _static("hasMany")), "belongs_to": F.when(grails("grails_domain"), _static("belongsTo")),
        "has_one": F.when(grails("grails_domain"), _static("hasOne")), "triggers": F.when(grails("grails_job"), _static("triggers")), "namespace": F.when(c("artifact_type") == "grails_taglib", c("namespace")),
        "has_init": F.when(grails("grails_bootstrap"), yes(F.array_contains("methods", "init"))), "has_destroy": F.when(grails("grails_bootstrap"), yes(F.array_contains("methods", "destroy"))),
    }
    held = F.map_filter(F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    named = d.select("id", c("role").alias("kind"), "name", "fqn", c("path").alias("file_path"), c("line").alias("line_start"), c("end_line").alias("line_end"), "language", "project_id", c("doc").alias("docstring"), c("content_hash").alias("source_hash"), held.alias("properties"))
    return _first(named, by_file)


def _first(symbols: DataFrame, by_file: bool) -> DataFrame:
    row, key = F.struct(*symbols.columns), ["project_id", "id", *(["file_path"] if by_file else [])]
    return symbols.groupBy(*key).agg(F.min_by(row, F.struct("file_path", "line_start", "fqn")).alias("row")).select("row.*")


def qualifier() -> Column:
    """The name of @Qualifier or @Resource on a field."""
    noted = F.concat_ws(" ", F.filter("annotations", lambda a: a.rlike("^@(Qualifier|Resource)")))
    return F.coalesce(_got(noted, r"(?:name|value)\s*=\s*\"([^\"]+)\""), _got(noted, r"\(\s*\"([^\"]+)\""))


def _edges(rows: DataFrame, kind: str | Column, source: Column, hint: Column, target: Column | None = None, line: str = "line", confidence: str | Column | None = None) -> DataFrame:
    known = target if target is not None else F.lit(None).cast("string")
    sure = confidence if confidence is not None else ("UNRESOLVED" if target is None else "EXACT")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        source.alias("source_id"), known.alias("target_id"), hint.alias("target_hint"), lit(kind).alias("type"), c("path").alias("file_path"), c(line).cast("long").alias("line"),
        lit(sure).alias("confidence"), F.concat(c("language"), F.lit("_code")).alias("extractor"), "project_id",
    )


def declared_edges(d: DataFrame) -> DataFrame:
    """Edges that heads, annotations and static fields tell."""
    none, types, files = F.lit(None).cast("string"), d.filter("what = 'type'"), F.concat(F.lit("file:"), c("path"))
    key = lambda name, value: F.concat(F.lit(f"{name}:"), value)
    imports = key("imports", F.concat_ws(",", "imports"))
    members = d.filter("what <> 'type'")
    out = [_edges(members, F.when(c("role") == "custom_tag", "DEFINES_TAG").otherwise("DECLARES"), c("owner_id"), none, c("id"))]
    for column, kind, name in (("extends", "EXTENDS", "class"), ("implements", "IMPLEMENTS", "interface")):
        out.append(_edges(types.withColumn("up", F.explode(column)), kind, c("id"), F.concat_ws("|", key(name, c("up")), files, imports)))
    out.append(_edges(d.withColumn("note", F.explode("annotations")), "ANNOTATED_WITH", c("id"), key("annotation", c("note"))))
    fields = d.filter((c("what") == "field") & (c("type") != ""))
    inject = F.concat_ws("|", key("service", c("name")), key("class", c("owner")), files, key("type", F.element_at(F.split("type", "<"), 1)), key("qualifier", qualifier()))
    out.append(_edges(fields.filter(injected()), "INJECTS", c("id"), inject))
    out.append(_edges(fields, "USES_TYPE", c("id"), key("type", F.element_at(F.split("type", r"[<\[]"), 1))))
    related = types.filter("artifact_type = 'grails_domain'").withColumn("said", F.explode(F.array(_static("hasMany"), _static("belongsTo")))).filter("said is not null")
    mapped, listed = _all(c("said"), r"\w+\s*:\s*((?:\w+\.)*[A-Z]\w*)"), _all(c("said"), r"\b((?:\w+\.)*[A-Z]\w*)")
    out.append(_edges(related.withColumn("to", F.explode(F.when(F.size(mapped) > 0, mapped).otherwise(listed))), "HAS_RELATION", c("id"), key("domain", c("to"))))
    commands = d.filter("role = 'action'").withColumn("command", F.explode(F.filter("param_types", lambda t: t.rlike("Command$"))))
    out.append(_edges(commands, "BINDS_COMMAND", c("id"), key("command", c("command"))))
    return reduce(DataFrame.unionByName, out)


def body_lines(d: DataFrame) -> DataFrame:
    """The statements of bodies, line by line: at, said and bare (said without strings)."""
    rows = d.filter(c("body").isNotNull()).withColumn("s", F.explode("said")).withColumns({"at": c("s.at"), "said": c("s.said")}).drop("s")
    return rows.withColumn("bare", F.regexp_replace("said", r"\"(\\.|[^\"\\])*\"|'(\\.|[^'\\])*'", "''")).drop("body")


def body_edges(lines: DataFrame) -> DataFrame:
    """CALLS and INSTANTIATES of every body, and what the actions of controllers do."""
    said, bare, action = c("said"), c("bare"), c("role") == "action"
    struct = lambda kind, hint, sure="UNRESOLVED": F.struct(F.lit(kind).alias("type"), hint.alias("hint"), F.lit(sure).alias("confidence"))
    key = lambda name, value: F.concat(F.lit(f"{name}:"), value)
    quoted = lambda name: _got(said, rf"\b{name}\s*:\s*[\"']([^\"']+)[\"']")
    one = lambda kind, hint, fits, sure="UNRESOLVED": F.when(action & fits & hint.isNotNull(), F.array(struct(kind, hint, sure))).otherwise(F.array().cast(FOUND))
    own = F.regexp_replace(F.element_at(F.split("owner", r"\."), -1), "Controller$", "")
    file = key("file", c("path"))

    def call(m: Column) -> Column:
        """`new T(` or `a.b.name(`; a receiver that is itself an expression is `?`."""
        made, name = m.startswith("new "), F.substring_index(m, ".", -1)
        before = F.left(m, F.length(m) - F.length(name) - 1)
        receiver = F.when(~m.contains("."), F.lit("")).when(before == "", F.lit("?")).otherwise(before)
        hint = F.when(made, F.concat_ws("|", key("class", F.trim(F.substring(m, 5, 1 << 30))), file)).otherwise(F.concat_ws("|", key("method", name), key("receiver", receiver), file))
        return F.struct(F.when(made, "INSTANTIATES").otherwise("CALLS").alias("type"), hint.alias("hint"), F.lit("UNRESOLVED").alias("confidence"))

    calls = F.filter(_all(bare, r"((?:\bnew )?(?:\.|\b)[A-Za-z_][\w.]*)\s*(?:<[\w, ?]*>)?\s*\("), lambda m: ~m.isin(KEYWORDS))
    renders, redirects = bare.rlike(r"\brender\b"), bare.rlike(r"\bredirect\b")
    place = F.coalesce(key("controller", quoted("controller")), key("source_controller", own))
    moved = F.when(quoted("uri").isNotNull(), key("uri", quoted("uri"))).otherwise(F.concat_ws("|", key("action", quoted("action")), place))
    found = F.concat(
        F.transform(calls, call),
        one("RENDERS", F.concat(key("view", quoted("view")), F.lit("|controller:"), own), renders),
        one("RETURNS_FORMAT", F.lit("format:json"), renders & said.rlike(r"(?i)\bas JSON\b|format\s*:\s*[\"']json|contentType\s*:\s*[\"'][^\"']*json"), "EXACT"),
        one("RETURNS_STATUS", key("status", _got(said, r"\bstatus\s*:\s*([\w.]+)")), renders, "EXACT"),
        one("REDIRECTS_TO", moved, redirects), one("FORWARDS_TO", moved, bare.rlike(r"\bforward\b")), one("CHAINS_TO", moved, bare.rlike(r"\bchain\b")),
        F.when(action, F.transform(_all(bare, QUERIES), lambda t: struct("QUERIES_DOMAIN", key("domain", t)))).otherwise(F.array().cast(FOUND)),
    )
    rows = lines.withColumn("found", F.explode(found))
    return _edges(rows, c("found.type"), c("id"), c("found.hint"), line="at", confidence=c("found.confidence"))


def _nodes(rows: DataFrame, tag: str, kind: str, key: Column, name: Column, fqn: Column, line: str, **properties: Column) -> DataFrame:
    held = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v)]) if properties else F.create_map().cast("map<string,string>")
    return rows.select(
        _id(F.lit(tag), key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), fqn.alias("fqn"), c("path").alias("file_path"), c(line).cast("long").alias("line_start"), c(line).cast("long").alias("line_end"),
        "language", "project_id", F.lit("").alias("docstring"), c("content_hash").alias("source_hash"), F.map_filter(held, lambda _, v: v.isNotNull()).alias("properties"),
    )


def used(lines: DataFrame, d: DataFrame, by_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """What bodies and annotations use beside code: request parameters, HTTP services, exchanges and cache regions; nodes and edges."""
    none = F.lit(None).cast("string")
    read = F.concat(_all(c("bare"), r"\bparams\.(\w+)\b(?!\s*\()"), _all(c("said"), r"\bparams\.\w+\(\s*[\"'](\w+)"), _all(c("said"), r"\bparams\[\s*[\"'](\w+)"))
    asked = lines.filter("role = 'action'").withColumn("name", F.explode(F.array_distinct(read))).withColumn("key", F.concat_ws("#", "fqn", "name"))
    # Names of HTTP clients and of what publishes to an exchange.
    http = lines.withColumn("verb", _got(c("bare"), r"\b(?:restTemplate|webClient|httpBuilder)\s*\.\s*(\w+)\s*\(")).withColumn("url", _got(c("said"), r"[\"'](https?://[^\"']+)[\"']")).filter("verb is not null or url is not null")
    http = http.withColumn("reached", F.coalesce("url", "verb")).withColumn("key", F.concat_ws("_", "reached", c("at").cast("string")))
    queue = lines.withColumn("key", _got(c("said"), r"\b(?:rabbitTemplate\s*\.\s*(?:convertAndSend|send)|rabbitSend)\s*\(?\s*[\"']([^\"']+)[\"']")).filter("key is not null")
    cached = d.withColumn("note", F.explode(F.filter("annotations", lambda a: a.rlike("^@Cache(able|Evict|Put)")))).withColumn("key", _got(c("note"), r"[\"']([^\"']+)[\"']")).filter("key is not null")
    nodes = [
        _nodes(asked, "query_param", "query_param", c("key"), c("name"), c("key"), "at", action_id=c("id")), _nodes(http, "external_http", "external_http", c("key"), c("reached"), c("reached"), "at", url_hint=c("url"), method=c("verb")),
        _nodes(queue, "mq_exchange", "mq_exchange", c("key"), c("key"), c("key"), "at"), _nodes(cached, "cache_region", "cache_region", c("key"), c("key"), c("key"), "line"),
    ]
    edges = [
        _edges(asked, "ACCEPTS_PARAM", c("id"), none, _id(F.lit("query_param"), "key"), "at"),
        _edges(http, "CALLS_EXTERNAL", c("id"), none, _id(F.lit("external_http"), "key"), "at", F.when(c("url").isNotNull(), "EXACT").otherwise("LIKELY")),
        _edges(queue, "PUBLISHES_TO", c("id"), none, _id(F.lit("mq_exchange"), "key"), "at"),
        _edges(cached, F.when(c("note").startswith("@CacheEvict"), "EVICTS_CACHE").otherwise("CACHED_BY"), c("id"), none, _id(F.lit("cache_region"), "key")),
    ]
    return _first(reduce(DataFrame.unionByName, nodes), by_file), reduce(DataFrame.unionByName, edges)


def configured(files: DataFrame, d: DataFrame, by_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """URL mappings, filters, Spring beans, plugins and interceptors: nodes and edges of the files that configure an application."""
    none = F.lit(None).cast("string")
    bare = F.regexp_replace("text", r"(?m)^\s*//.*$", "")
    of = lambda kind, pattern: files.filter(c("artifact_type") == kind).withColumn("text", bare).withColumn("said", F.explode(_all(c("text"), pattern, 0))).withColumn("line", line_of(c("text"), c("said")))
    said = c("said")
    part = lambda name: F.nullif(_got(said, rf"\b{name}\s*[:=]\s*[\"']([^\"']+)[\"']"), F.lit("*"))
    hinted = F.nullif(F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), part(k)) for k in ("controller", "action", "uri")]), F.lit(""))
    urls = of("grails_urlmappings", r"(?:\bname\s+\w+\s*:\s*)?[\"'](?:/[^\"'\n]*|[0-9]{3})[\"']\s*(?:\([^)]*\)|\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})")
    urls = urls.withColumn("pattern", F.regexp_extract(said, r"[\"'](/[^\"'\n]*|[0-9]{3})[\"']", 1)).withColumn("called", F.coalesce(_got(said, r"^name\s+(\w+)"), c("pattern"))).withColumn("hint", hinted)
    asked = urls.withColumn("name", F.explode(F.array_distinct(_all(c("pattern"), r"\$\{?(\w+)")))).withColumn("key", F.concat_ws("#", "pattern", "name"))
    filters = of("grails_filters", r"\b\w+\s*\(\s*(?:controller|action|uri|find|regex|invert)\w*\s*:[^)]*\)\s*\{").withColumn("name", F.regexp_extract(said, r"^(\w+)", 1)).withColumn("hint", F.coalesce(hinted, F.lit("all")))
    beans = of("grails_spring_dsl", r"(?m)^[ \t]*\w+\s*\(\s*(?:[a-z]\w*\.)*[A-Z]\w*\s*[,)]").withColumn("name", F.regexp_extract(said, r"(\w+)", 1)).withColumn("made", F.regexp_extract(said, r"\(\s*([\w.]+)", 1))
    plugins = of("grails_buildconfig", r"(?:\b\w+\s*\(?\s*)?[\"']:[\w-]+:[\w.-]+[\"']").withColumn("name", F.regexp_extract(said, r":([\w-]+):", 1))
    rules = body_lines(d.filter("artifact_type = 'grails_interceptor' and what = 'constructor'")).withColumn("said", F.explode(_all(c("said"), r"\b(?:matchAll|match)\b\s*\(?[^)]*", 0))).withColumn("hint", F.when(said.startswith("matchAll"), F.lit("all")).otherwise(hinted))
    sure = F.when(c("hint") == "all", "HEURISTIC").when(c("hint").contains("controller:"), "LIKELY").otherwise("UNRESOLVED")
    nodes = [
        _nodes(urls, "url_mapping", "url_mapping", c("called"), c("called"), c("pattern"), "line", controller=part("controller"), action=part("action"), view=part("view")), _nodes(asked, "url_param", "url_param", c("key"), c("name"), c("key"), "line"),
        _nodes(filters, "filter", "grails_filters", c("name"), c("name"), c("name"), "line"), _nodes(beans, "bean", "bean", c("name"), c("name"), c("made"), "line", bean_name=c("name"), class_name=c("made")),
        _nodes(plugins, "plugin_dep", "grails_plugin_dep", c("name"), c("name"), c("name"), "line", version=F.regexp_extract(said, r":([\w.-]+)[\"']", 1), scope=F.coalesce(_got(said, r"^(\w+)"), F.lit("compile"))),
    ]
    edges = [
        _edges(urls.filter("hint is not null"), "MAPS_TO", _id(F.lit("url_mapping"), "called"), c("hint")), _edges(filters, "APPLIES_TO", _id(F.lit("filter"), "name"), c("hint")),
        _edges(rules.filter("hint is not null"), "APPLIES_TO", c("owner_id"), c("hint"), line="at", confidence=sure), _edges(beans, "PROVIDES", _id(F.lit("bean"), "name"), F.concat(F.lit("class:"), c("made")), confidence="EXACT"),
        _edges(asked, "ACCEPTS_PARAM", _id(F.lit("url_mapping"), "called"), none, _id(F.lit("url_param"), "key")),
    ]
    return _first(reduce(DataFrame.unionByName, nodes), by_file), reduce(DataFrame.unionByName, edges)


def bare_files(files: DataFrame, d: DataFrame) -> DataFrame:
    """One symbol for each source file that declares no type."""
    kind = kind_of(c("artifact_type"))
    rest = files.join(d.filter("what = 'type'").select("project_id", "path").distinct(), ["project_id", "path"], "left_anti")
    return rest.select(
        _id(kind, "path").alias("id"), kind.alias("kind"), F.regexp_extract("path", r"([^/]+?)(\.\w+)?$", 1).alias("name"), c("path").alias("fqn"), c("path").alias("file_path"), F.lit(1).cast("long").alias("line_start"),
        F.lit(1).cast("long").alias("line_end"), "language", "project_id", F.lit("").alias("docstring"), c("content_hash").alias("source_hash"), F.create_map(F.lit("file"), c("path")).alias("properties"),
    )


def imports(symbols: DataFrame) -> DataFrame:
    """file_path, position and import of the types in symbols."""
    said = symbols.select("file_path", F.posexplode(F.split(F.try_element_at("properties", F.lit("imports")), ",")).alias("position", "import"))
    return said.filter("import <> ''").distinct()
