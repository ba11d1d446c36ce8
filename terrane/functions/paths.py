"""Column expressions on file paths: classification, ignore rules, scopes and the size gate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules, first match wins: path prefix, pattern of the base name (None: the prefix is the whole
# path), artifact type, language.
COMMON_RULES = [
    ("", ".gitignore", "gitignore", "text"),
    ("", ".mcpignore", "mcpignore", "text"),
    ("", ".editorconfig", "editorconfig", "text"),
    ("", ".gitattributes", "gitattributes", "text"),
    ("grails-app/controllers/", "*controller.groovy", "grails_controller", "groovy"),
    ("grails-app/services/", "*service.groovy", "grails_service", "groovy"),
    ("grails-app/domain/", "*.groovy", "grails_domain", "groovy"),
    ("grails-app/taglib/", "*taglib.groovy", "grails_taglib", "groovy"),
    ("grails-app/jobs/", "*job.groovy", "grails_job", "groovy"),
    ("grails-app/conf/urlmappings.groovy", None, "grails_urlmappings", "groovy"),
    ("grails-app/conf/", "*filters.groovy", "grails_filters", "groovy"),
    ("grails-app/views/layouts/", "*.gsp", "gsp_layout", "gsp"),
    ("grails-app/views/", "_*.gsp", "gsp_template", "gsp"),
    ("grails-app/views/", "*.gsp", "gsp_view", "gsp"),
    ("", "*.jspf", "jsp_include", "jsp"),
    ("", "*.jsp", "jsp_view", "jsp"),
    ("", "*.java", "plain_java", "java"),
    ("", "*.xml", "xml_config", "xml"),
    ("", "*.properties", "properties_config", "properties"),
]
VERSION_RULES = {
    "3.x": [
        ("grails-app/controllers/", "*interceptor.groovy", "grails_interceptor", "groovy"),
        ("grails-app/conf/", "resources.groovy", "grails_spring_dsl", "groovy"),
        ("grails-app/conf/application.yml", None, "grails_config", "yaml"),
        ("grails-app/conf/application.groovy", None, "grails_config", "groovy"),
        ("src/main/groovy/", "*.groovy", "plain_groovy", "groovy"),
        ("src/main/java/", "*.java", "plain_java", "java"),
        ("", "*.yml", "yaml_config", "yaml"),
        ("", "*.yaml", "yaml_config", "yaml"),
        ("", "*.groovy", "plain_groovy", "groovy"),
    ],
    "2.x": [
        ("grails-app/conf/config.groovy", None, "grails_config", "groovy"),
        ("grails-app/conf/datasource.groovy", None, "grails_datasource", "groovy"),
        ("grails-app/conf/buildconfig.groovy", None, "grails_buildconfig", "groovy"),
        ("grails-app/conf/bootstrap.groovy", None, "grails_bootstrap", "groovy"),
        ("grails-app/conf/spring/resources.groovy", None, "grails_spring_dsl", "groovy"),
        ("grails-app/conf/spring/", "*.groovy", "grails_spring_dsl", "groovy"),
        ("src/groovy/", "*.groovy", "plain_groovy", "groovy"),
        ("src/java/", "*.java", "plain_java", "java"),
        ("web-app/", "*.jsp", "jsp_view", "jsp"),
        ("web-app/", "*.jspf", "jsp_include", "jsp"),
        ("", "*.groovy", "plain_groovy", "groovy"),
    ],
}
# Directories, extensions and, by version, path prefixes that are never scanned.
IGNORED_DIRS = ["node_modules", ".idea", ".git"]
IGNORED_EXTENSIONS = [".class", ".jar", ".war", ".ear", ".min.js", ".min.css"]
IGNORED_PREFIXES = {"3.x": ["build/", "target/", "out/", ".gradle/", "dist/"], "2.x": ["target/", ".grails/", "staging/", "web-app/WEB-INF/classes/"]}
# Kinds by artifact type; the rest is plain_groovy.
KINDS = {
    "grails_controller": "controller", "grails_service": "service", "grails_domain": "domain", "grails_taglib": "tag_lib", "grails_job": "job",
    "grails_filters": "grails_filters", "grails_interceptor": "interceptor", "grails_urlmappings": "url_mappings", "grails_config": "grails_config",
    "grails_bootstrap": "bootstrap", "grails_buildconfig": "grails_buildconfig", "grails_spring_dsl": "grails_spring_dsl", "grails_datasource": "grails_datasource",
    "gsp_view": "gsp_view", "gsp_layout": "gsp_layout", "gsp_template": "gsp_template", "jsp_view": "jsp_view", "jsp_include": "jsp_include",
}


# What an artifact type is, by type.
METADATA = {
    "grails_controller": {"description": "Grails Controller", "convention": "*Controller.groovy", "actions": "public methods or closures"},
    "grails_service": {"description": "Grails Service", "convention": "*Service.groovy", "transactional": "true"},
    "grails_domain": {"description": "Grails Domain Class", "convention": "grails-app/domain/**/*.groovy", "orm": "GORM"},
    "grails_taglib": {"description": "Grails Tag Library", "convention": "*TagLib.groovy", "namespace": "static namespace"},
    "grails_job": {"description": "Grails Quartz Job", "convention": "*Job.groovy", "triggers": "static triggers or closure"},
    "grails_interceptor": {"description": "Grails 3.x Interceptor", "convention": "*Interceptor.groovy", "only_if": "Grails 3.x"},
    "grails_filters": {"description": "Grails 2.x Filters", "convention": "*Filters.groovy", "only_if": "Grails 2.x"},
    "grails_urlmappings": {"description": "URL Mappings", "file": "UrlMappings.groovy"},
    "grails_bootstrap": {"description": "Bootstrap Class", "file": "BootStrap.groovy", "methods": "init,destroy"},
    "grails_buildconfig": {"description": "Build Configuration", "file": "BuildConfig.groovy", "only_if": "Grails 2.x"},
    "grails_spring_dsl": {"description": "Spring Bean DSL", "file": "resources.groovy or spring/resources.groovy"},
    "grails_config": {"description": "Application Configuration", "files": "Config.groovy,application.groovy,application.yml"},
}


def metadata(artifact_type: Column) -> Column:
    """map<string,string> of what is known of an artifact type; empty for others."""
    chain = F.when(F.lit(False), F.create_map().cast("map<string,string>"))
    for kind, said in METADATA.items():
        chain = chain.when(artifact_type == kind, F.create_map(*[F.lit(x) for pair in said.items() for x in pair]))
    return chain.otherwise(F.create_map().cast("map<string,string>"))


def normal(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _matches(path: Column, name: Column, prefix: str, pattern: str | None) -> Column:
    if pattern is None:
        return path == prefix
    head, star, tail = pattern.partition("*")
    fits = name.startswith(head) & name.endswith(tail) if star else name == pattern
    return path.startswith(prefix) & fits if prefix else fits


def classify(path: Column, version: Column) -> Column:
    """struct<artifact_type, language>: the first rule that matches; a version that is neither 2.x nor 3.x has common rules only."""
    low = normal(path)
    name = basename(low)
    out = lambda kind, language: F.struct(F.lit(kind).alias("artifact_type"), F.lit(language).alias("language"))
    chain = F.when(low.isNull(), out("unknown", "unknown"))
    for prefix, pattern, kind, language in COMMON_RULES:
        chain = chain.when(_matches(low, name, prefix, pattern), out(kind, language))
    for own, rules in VERSION_RULES.items():
        for prefix, pattern, kind, language in rules:
            chain = chain.when((version == own) & _matches(low, name, prefix, pattern), out(kind, language))
    return chain.otherwise(out("unknown", "unknown"))


def kind_of(artifact_type: Column) -> Column:
    pairs = [F.lit(x) for item in KINDS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), artifact_type), F.lit("plain_groovy"))


def ignored(path: Column, version: Column) -> Column:
    """Hard-coded ignores, on whole path segments; a version other than 3.x has the list of 2.x."""
    dirs = path.rlike("(^|/)(" + "|".join(map(re.escape, IGNORED_DIRS)) + ")(/|$)")
    extension = path.rlike("(" + "|".join(map(re.escape, IGNORED_EXTENSIONS)) + ")$")
    under = lambda v: path.rlike("^(" + "|".join(map(re.escape, IGNORED_PREFIXES[v])) + ")")
    return dirs | extension | F.when(version == "3.x", under("3.x")).otherwise(under("2.x"))


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as a regular expression and whether it negates; None for blanks and comments."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    negates, line = line.startswith("!"), line.removeprefix("!")
    anchored, only_dir = "/" in line.rstrip("/"), line.endswith("/")
    parts = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    tokens = re.findall(r"/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\]|.", line.strip("/"))
    body = "".join(parts.get(x) or (x if re.fullmatch(r"\[[^\]]+\]", x) else re.escape(x)) for x in tokens)
    return ("^" if anchored else "(?:^|/)") + body + ("/" if only_dir else "(?:/|$)"), negates


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """The last matching line of the ignore files decides."""
    chain = F.when(F.lit(False), F.lit(False))
    for rule in reversed([r for p in patterns if (r := ignore_regex(p))]):
        chain = chain.when(path.rlike(rule[0]), F.lit(not rule[1]))
    return chain.otherwise(F.lit(False))


def in_scope(path: Column, scope: str) -> Column:
    """full, incremental, file:PATH, files:A,B (or separated by NUL, where names may hold commas) or module:PREFIX."""
    kind, _, value = scope.partition(":")
    if scope in ("full", "incremental"):
        return F.lit(True)
    if kind == "file" and value:
        return path == value
    if kind == "files" and value:
        return path.isin(value.split("\0" if "\0" in value else ","))
    if kind == "module" and value:
        return path.startswith(value)
    raise ValueError(f"unknown scope {scope!r}; known: full, incremental, file:, files:, module:")


def parse_status(length: Column, readable: Column, most_mb: int = 5) -> Column:
    return F.when(length > most_mb << 20, "skipped_size").when(~readable, "error_read").otherwise("pending")
