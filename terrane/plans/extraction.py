"""Extraction as queries: source files written from the driver's rows, and the symbols and edges that must come out of them.

Each file's text is a template filled with a row's numbers; the SQL beside a query builds what the extractor has to
find from the same rows, by the rules of the source language and not by the extractor's patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.plans.bindings import PROJECT
from terrane.plans.registry import query, staged, table
from terrane.sources import code, code_graph, configs, views

JAVA = """package com.n{n};

import com.base.Account{a};
import java.util.*;

/** Customer {k}.
 *  Kept. */
@Service("c{k}")
public class Customer{k} extends Base{a} implements Finder, java.io.Closeable {
    @Autowired @Qualifier("main{a}")
    private AccountRepository accounts;
    private static final int LIMIT = {a};
    Account{a} account;

    public Customer{k}(AccountRepository accounts) { this.accounts = accounts; }

    /** Finds. */
    @Cacheable("customers{a}")
    public Account{a} find(Long id, String name) {
        check("calls nothing(here)");
        accounts.load(id,
            name);
        restTemplate.getForObject("http://api/{n}", String.class);
        rabbitTemplate.convertAndSend("moves{a}", name);
        return new Account{a}(id);
    }

    protected abstract void check(String text);
}
"""
CONTROLLER = """package com.s

class Supply{k}Controller {
    static allowedMethods = [save: 'POST']
    def supplyService
    def index() {
        redirect(action: 'list', controller: 'supply{m}')
    }
    def list() {
        def rows = Supply{m}.findAllByName(params.name{m})
        render(view: 'list{m}', model: [rows: rows])
    }
    def save = { SaveCommand cmd ->
        render(status: 404, contentType: 'application/json')
    }
    def move() {
        forward(action: 'list')
        chain(action: 'save',
            controller: 'supply{k}')
    }
    private _hidden() { 1 }
}
"""
SERVICE = "package com.s\n\n@Transactional\nclass Supply{k}Service {\n    def approve(Supply{m} s) { s.save() }\n    private reject() { helper({k}) }\n}\n"
DOMAIN = (
    "package com.s\n\nclass Supply{k} {\n    String title\n    static hasMany = [items: Item{m}, notes: com.x.Note]\n    static belongsTo = [User{m}]\n"
    "    static mapping = {\n        table 'supply_{k}'\n    }\n}\n"
)
TAGLIB = "class Ui{k}TagLib {\n    static namespace = 'ui{m}'\n    def badge = { attrs, body -> out << 'x' }\n}\n"
JOB = "class Sync{k}Job {\n    static triggers = {\n        cron name: 'n{k}'\n    }\n    def execute() { run({m}) }\n}\n"
URLS = 'class UrlMappings {\n    static mappings = {\n        "/s{k}/$id"(controller: "supply{m}", action: "show")\n        name home{k}: "/h{k}"(view: "/index")\n    }\n}\n'
FILTERS = "class Auth{k}Filters {\n    def filters = {\n        all{k}(controller: '*', action: '*') {\n        }\n        some{k}(controller: 'supply{m}', action: 'save') {\n        }\n    }\n}\n"
INTERCEPTOR = "class Guard{k}Interceptor {\n    Guard{k}Interceptor() {\n        match(controller: 'supply{m}', action: '*')\n        matchAll().excludes(controller: 'login')\n    }\n}\n"
BEANS = "beans = {\n    mailer{k}(com.x.Mailer{m}) {\n        host = 'a'\n    }\n}\n"
BOOTSTRAP = "class BootStrap {\n    def init = { servletContext -> seed({k}) }\n}\n"
PLUGINS = 'plugins {\n    build ":tomcat{k}:7.0.{m}"\n    compile(":mail{k}:1.0")\n}\n'
SCRIPT = "app.name = 'supply{k}'\ndataSource {\n    url = \"jdbc:x{m}\"\n    password = 'hush'\n    pool {\n        size = {k}\n    }\n}\nenvironments {\n    test {\n        app.name = 'no'\n    }\n}\n"
GENERIC = "package com.g\n\ntrait Plain{k} {\n    String title\n    static int LIMIT = {m}\n    def go(int a, b) { helper(a) }\n    protected void stop() {}\n}\n"
GSP = """<%@ taglib uri="/tags/t{m}" prefix="t" %>
<html><head><meta name="layout" content="main{m}"/></head>
<body>
<g:each in="${items}" var="i">
<g:link controller="part" action="show{m}">Part {k}</g:link>
</g:each>
<g:render template="row{m}"/>
<f:field name="x"/>
${total} ${items}
<% int n = 1 %> <%= n %>
</body></html>
"""
JSP = """<%@ page import="a.B" %>
<%@ taglib uri="/tags/c{m}" prefix="c" %>
<%@ include file="/head{m}.jspf" %>
<jsp:include page="/part{k}.jsp"/>
<jsp:forward page="/end{m}.jsp"/>
${part.name} <% code(); %> <%= {k} %>
"""
XML = """<?xml version="1.0"?>
<beans xmlns="http://b/beans" xmlns:p="http://b/p">
  <bean id="store{k}" class="com.x.Store{m}" scope="prototype" lazy-init="true">
    <constructor-arg index="0" value="v{k}"/>
    <property name="mailer" ref="mailer{m}"/>
    <property name="size" value="{k}"/>
  </bean>
  <alias name="store{k}" alias="shop{k}"/>
</beans>
"""
PROPERTIES = "# order {k}\norder.key={k}\norder.token: s{k}\norder.note = a \\\n   b{m}\norder.key=n{k}\nspring.datasource.url=jdbc:y{m}\njdbc.user=u{k}\n! end\n"
YAML = "spring:\n  profiles: dev{m}, test\n  config:\n    activate:\n      on-profile: live{k}\nlist: [{k}, {m}]\nnone: []\ndeep:\n  password: hush\n---\nlater: true\n"


def written(spark: SparkSession, sf_dir: str, name: str, key: str, template: str, path: str, kind: str, language: str, divisor: int = 7, **columns: str) -> DataFrame:
    """A file for each row of a table: {k} is its key, {m} and {a} the key modulo the divisor, other braces are columns."""
    # The driver's tables are single files: their rows are dealt out before they become source text.
    rows = table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism).select(F.col(key).alias("k"), (F.col(key) % divisor).alias("m"), (F.col(key) % divisor).alias("a"), *[F.col(v).alias(c) for c, v in columns.items()])

    def filled(text: str) -> Column:
        out = F.lit(text)
        for c in ("k", "m", "a", *columns):
            out = F.replace(out, F.lit("{" + c + "}"), F.col(c).cast("string"))
        return out

    return rows.select(F.lit(PROJECT).alias("project_id"), filled(path).alias("path"), F.lit(kind).alias("artifact_type"), F.lit(language).alias("language"), F.lit("h").alias("content_hash"), filled(template).alias("text"))


def _java(spark, sf_dir):
    return written(spark, sf_dir, "customer", "c_custkey", JAVA, "src/C{k}.java", "plain_java", "java", n="c_nationkey")


def _groovy(spark, sf_dir, template: str, path: str, kind: str):
    return written(spark, sf_dir, "supplier", "s_suppkey", template, path, kind, "groovy")


def _declared(files: DataFrame) -> DataFrame:
    return code_graph.described(staged(code.declarations(files)))


def _said(symbols: DataFrame, *kinds: str, **properties: str) -> DataFrame:
    rows = symbols.filter(F.col("kind").isin(*kinds)) if kinds else symbols
    return rows.select("id", "kind", "name", "fqn", *[F.try_element_at("properties", F.lit(p)).alias(c) for c, p in properties.items()])


def _linked(edges: DataFrame, *types: str) -> DataFrame:
    rows = edges.filter(F.col("type").isin(*types)) if types else edges
    return rows.select("type", "source_id", F.coalesce("target_id", "target_hint").alias("target"), "line", "confidence")


C = f"WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 7 AS a, concat('com.n', c_nationkey, '.Customer', c_custkey) AS own, concat('{PROJECT}:') AS p, concat('file:src/C', c_custkey, '.java') AS f FROM customer)"
S = f"WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 AS m, '{PROJECT}:' AS p FROM supplier)"
P = f"WITH t AS (SELECT p_partkey AS k, p_partkey % 7 AS m, '{PROJECT}:' AS p FROM part)"


# --- Java


@query(f"{C} SELECT concat(p, 'class:', own) AS id, 'class' AS kind, concat('Customer', k) AS name, own AS fqn, 'public' AS visibility, 'false' AS abstract, concat('Customer ', k, '.', chr(10), 'Kept.') AS doc, CAST(8 AS BIGINT) AS line_start, CAST(29 AS BIGINT) AS line_end FROM c")
def java_types(spark, sf_dir):
    found = code_graph.code_symbols(_declared(_java(spark, sf_dir))).filter("kind = 'class'")
    return _said(found, visibility="visibility", abstract="is_abstract").join(found.select("id", F.col("docstring").alias("doc"), "line_start", "line_end"), "id")


@query(f"""{C} SELECT concat(p, 'method:', own, '#find(Long,String)') AS id, 'method' AS kind, 'find' AS name, concat(own, '#find(Long,String)') AS fqn, 'public' AS visibility, concat('Account', a) AS returns, '["id","name"]' AS params FROM c
    UNION ALL SELECT concat(p, 'method:', own, '#check(String)'), 'method', 'check', concat(own, '#check(String)'), 'protected', 'void', '["text"]' FROM c""")
def java_methods(spark, sf_dir):
    return _said(code_graph.code_symbols(_declared(_java(spark, sf_dir))), "method", visibility="visibility", returns="return_type", params="params")


@query(f"{C} SELECT concat(p, 'constructor:', own, '#Customer', k, '(AccountRepository)') AS id, 'constructor' AS kind, concat('Customer', k) AS name, concat(own, '#Customer', k, '(AccountRepository)') AS fqn FROM c")
def java_constructors(spark, sf_dir):
    return _said(code_graph.code_symbols(_declared(_java(spark, sf_dir))), "constructor")


@query(f"""{C} SELECT concat(p, 'field:', own, '#accounts') AS id, 'field' AS kind, 'accounts' AS name, concat(own, '#accounts') AS fqn, 'AccountRepository' AS hint, 'true' AS injected, concat('main', a) AS qualifier, 'private' AS visibility, 'false' AS static FROM c
    UNION ALL SELECT concat(p, 'field:', own, '#LIMIT'), 'field', 'LIMIT', concat(own, '#LIMIT'), 'int', 'false', NULL, 'private', 'true' FROM c
    UNION ALL SELECT concat(p, 'field:', own, '#account'), 'field', 'account', concat(own, '#account'), concat('Account', a), 'false', NULL, 'package-private', 'false' FROM c""")
def java_fields(spark, sf_dir):
    found = code_graph.code_symbols(_declared(_java(spark, sf_dir)))
    return _said(found, "field", hint="type_hint", injected="injection_point", qualifier="qualifier_hint", visibility="visibility", static="is_static")


@query(f"""{C}, i AS (SELECT *, concat('|', f, '|imports:com.base.Account', a, ',java.util.*') AS rest, concat(p, 'class:', own) AS id FROM c)
    SELECT 'EXTENDS' AS type, id AS source_id, concat('class:Base', a, rest) AS target, CAST(8 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM i
    UNION ALL SELECT 'IMPLEMENTS', id, concat('interface:', x, rest), 8, 'UNRESOLVED' FROM i, (VALUES ('Finder'), ('java.io.Closeable')) v(x)
    UNION ALL SELECT 'DECLARES', id, concat(p, 'field:', own, '#', x), l, 'EXACT' FROM i, (VALUES ('accounts', 10), ('LIMIT', 12), ('account', 13)) v(x, l)
    UNION ALL SELECT 'DECLARES', id, concat(p, 'method:', own, '#', x), l, 'EXACT' FROM i, (VALUES ('find(Long,String)', 18), ('check(String)', 28)) v(x, l)
    UNION ALL SELECT 'DECLARES', id, concat(p, 'constructor:', own, '#Customer', k, '(AccountRepository)'), 15, 'EXACT' FROM i
    UNION ALL SELECT 'ANNOTATED_WITH', id, concat('annotation:@Service("c', k, '")'), 8, 'UNRESOLVED' FROM i
    UNION ALL SELECT 'ANNOTATED_WITH', concat(p, 'field:', own, '#accounts'), x, 10, 'UNRESOLVED' FROM (SELECT *, unnest(['annotation:@Autowired', concat('annotation:@Qualifier("main', a, '")')]) AS x FROM i)
    UNION ALL SELECT 'ANNOTATED_WITH', concat(p, 'method:', own, '#find(Long,String)'), concat('annotation:@Cacheable("customers', a, '")'), 18, 'UNRESOLVED' FROM i""")
def java_heads(spark, sf_dir):
    return _linked(code_graph.declared_edges(_declared(_java(spark, sf_dir))), "EXTENDS", "IMPLEMENTS", "DECLARES", "ANNOTATED_WITH")


@query(f"""{C} SELECT 'INJECTS' AS type, concat(p, 'field:', own, '#accounts') AS source_id, concat('service:accounts|class:', own, '|', f, '|type:AccountRepository|qualifier:main', a) AS target, CAST(10 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM c
    UNION ALL SELECT 'USES_TYPE', concat(p, 'field:', own, '#accounts'), 'type:AccountRepository', 10, 'UNRESOLVED' FROM c
    UNION ALL SELECT 'USES_TYPE', concat(p, 'field:', own, '#LIMIT'), 'type:int', 12, 'UNRESOLVED' FROM c
    UNION ALL SELECT 'USES_TYPE', concat(p, 'field:', own, '#account'), concat('type:Account', a), 13, 'UNRESOLVED' FROM c""")
def java_injects(spark, sf_dir):
    return _linked(code_graph.declared_edges(_declared(_java(spark, sf_dir))), "INJECTS", "USES_TYPE")


@query(f"""{C}, m AS (SELECT *, concat(p, 'method:', own, '#find(Long,String)') AS id FROM c)
    SELECT 'CALLS' AS type, id AS source_id, concat('method:', x, '|receiver:', r, '|', f) AS target, CAST(l AS BIGINT) AS line, 'UNRESOLVED' AS confidence
    FROM m, (VALUES ('check', '', 20), ('load', 'accounts', 21), ('getForObject', 'restTemplate', 23), ('convertAndSend', 'rabbitTemplate', 24)) v(x, r, l)
    UNION ALL SELECT 'INSTANTIATES', id, concat('class:Account', a, '|', f), 25, 'UNRESOLVED' FROM m""")
def java_calls(spark, sf_dir):
    """A call over two lines has its first line's number; what strings hold calls nothing."""
    return _linked(code_graph.body_edges(code_graph.body_lines(_declared(_java(spark, sf_dir)))))


@query(f"{C} SELECT concat('src/C', k, '.java') AS file_path, 0 AS position, concat('com.base.Account', a) AS \"import\" FROM c UNION ALL SELECT concat('src/C', k, '.java'), 1, 'java.util.*' FROM c")
def java_imports(spark, sf_dir):
    return code_graph.imports(code_graph.code_symbols(_declared(_java(spark, sf_dir))).filter("kind = 'class'"))


@query(f"""{C}, m AS (SELECT *, concat(p, 'method:', own, '#find(Long,String)') AS id FROM c)
    SELECT 'CALLS_EXTERNAL' AS type, id AS source_id, concat(p, 'external_http:http://api/', n, '_23') AS target, CAST(23 AS BIGINT) AS line, 'EXACT' AS confidence FROM m
    UNION ALL SELECT 'PUBLISHES_TO', id, concat(p, 'mq_exchange:moves', a), 24, 'EXACT' FROM m
    UNION ALL SELECT 'CACHED_BY', id, concat(p, 'cache_region:customers', a), 18, 'EXACT' FROM m""")
def integrations(spark, sf_dir):
    d = _declared(_java(spark, sf_dir))
    return _linked(code_graph.used(code_graph.body_lines(d), d)[1])


@query(f"""{C} SELECT DISTINCT concat(p, 'external_http:http://api/', n, '_23') AS id, 'external_http' AS kind, concat('http://api/', n) AS name, 'getForObject' AS method FROM c
    UNION ALL SELECT DISTINCT concat(p, 'mq_exchange:moves', a), 'mq_exchange', concat('moves', a), NULL FROM c UNION ALL SELECT DISTINCT concat(p, 'cache_region:customers', a), 'cache_region', concat('customers', a), NULL FROM c""")
def integration_nodes(spark, sf_dir):
    d = _declared(_java(spark, sf_dir))
    return _said(code_graph.used(code_graph.body_lines(d), d)[0], method="method").drop("fqn")


# --- Groovy


@query(f"""{S}, o AS (SELECT *, concat('com.s.Supply', k, 'Controller') AS own FROM s)
    SELECT concat(p, 'controller:', own) AS id, 'controller' AS kind, concat('Supply', k, 'Controller') AS name, own AS fqn, '[save: ''POST'']' AS allowed FROM o
    UNION ALL SELECT concat(p, kind, ':', own, '#', x), kind, x, concat(own, '#', x), NULL FROM o, (VALUES ('field', 'allowedMethods'), ('field', 'supplyService'), ('action', 'index'), ('action', 'list'), ('action', 'save'), ('action', 'move'), ('method', '_hidden')) v(kind, x)""")
def controllers(spark, sf_dir):
    return _said(code_graph.code_symbols(_declared(_groovy(spark, sf_dir, CONTROLLER, "grails-app/controllers/Supply{k}Controller.groovy", "grails_controller"))), allowed="allowed_methods")


@query(f"""{S}, o AS (SELECT *, concat(p, 'action:com.s.Supply', k, 'Controller#') AS own FROM s)
    SELECT 'REDIRECTS_TO' AS type, concat(own, 'index') AS source_id, concat('action:list|controller:supply', m) AS target, CAST(7 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM o
    UNION ALL SELECT 'QUERIES_DOMAIN', concat(own, 'list'), concat('domain:Supply', m), 10, 'UNRESOLVED' FROM o
    UNION ALL SELECT 'RENDERS', concat(own, 'list'), concat('view:list', m, '|controller:Supply', k), 11, 'UNRESOLVED' FROM o
    UNION ALL SELECT 'RETURNS_FORMAT', concat(own, 'save'), 'format:json', 14, 'EXACT' FROM o
    UNION ALL SELECT 'RETURNS_STATUS', concat(own, 'save'), 'status:404', 14, 'EXACT' FROM o
    UNION ALL SELECT 'FORWARDS_TO', concat(own, 'move'), concat('action:list|source_controller:Supply', k), 17, 'UNRESOLVED' FROM o
    UNION ALL SELECT 'CHAINS_TO', concat(own, 'move'), concat('action:save|controller:supply', k), 18, 'UNRESOLVED' FROM o
    UNION ALL SELECT 'ACCEPTS_PARAM', concat(own, 'list'), concat(p, 'query_param:com.s.Supply', k, 'Controller#list#name', m), 10, 'EXACT' FROM o""")
def action_bodies(spark, sf_dir):
    d = _declared(_groovy(spark, sf_dir, CONTROLLER, "grails-app/controllers/Supply{k}Controller.groovy", "grails_controller"))
    lines = code_graph.body_lines(d)
    return _linked(code_graph.body_edges(lines).filter("type <> 'CALLS'")).unionByName(_linked(code_graph.used(lines, d)[1], "ACCEPTS_PARAM"))


@query(f"{S} SELECT 'BINDS_COMMAND' AS type, concat(p, 'action:com.s.Supply', k, 'Controller#bind') AS source_id, concat('command:Save', m, 'Command') AS target, CAST(2 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM s")
def bound_commands(spark, sf_dir):
    source = "package com.s; class Supply{k}Controller {\n    def bind(Save{m}Command cmd) { }\n}\n"
    return _linked(code_graph.declared_edges(_declared(_groovy(spark, sf_dir, source, "grails-app/controllers/Supply{k}Controller.groovy", "grails_controller"))), "BINDS_COMMAND")


@query(f"""{S}, o AS (SELECT *, concat('com.s.Supply', k, 'Service') AS own FROM s)
    SELECT concat(p, 'service:', own) AS id, 'service' AS kind, concat('Supply', k, 'Service') AS name, own AS fqn, concat('supply', k, 'Service') AS bean, 'true' AS transactional FROM o
    UNION ALL SELECT concat(p, 'method:', own, '#', x), 'method', x, concat(own, '#', x), NULL, NULL FROM o, (VALUES ('approve'), ('reject')) v(x)""")
def services(spark, sf_dir):
    return _said(code_graph.code_symbols(_declared(_groovy(spark, sf_dir, SERVICE, "grails-app/services/Supply{k}Service.groovy", "grails_service"))), bean="bean_name", transactional="transactional")


@query(f"{S} SELECT concat(p, 'domain:com.s.Supply', k) AS id, 'domain' AS kind, concat('Supply', k) AS name, concat('com.s.Supply', k) AS fqn, concat('supply_', k) AS table_name, concat('[items: Item', m, ', notes: com.x.Note]') AS has_many FROM s")
def domains(spark, sf_dir):
    return _said(code_graph.code_symbols(_declared(_groovy(spark, sf_dir, DOMAIN, "grails-app/domain/Supply{k}.groovy", "grails_domain"))), "domain", table_name="table_name", has_many="has_many")


@query(f"{S} SELECT 'HAS_RELATION' AS type, concat(p, 'domain:com.s.Supply', k) AS source_id, unnest([concat('domain:Item', m), 'domain:com.x.Note', concat('domain:User', m)]) AS target, CAST(3 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM s")
def domain_relations_found(spark, sf_dir):
    return _linked(code_graph.declared_edges(_declared(_groovy(spark, sf_dir, DOMAIN, "grails-app/domain/Supply{k}.groovy", "grails_domain"))), "HAS_RELATION")


@query(f"""{S} SELECT 'DEFINES_TAG' AS type, concat(p, 'taglib:Ui', k, 'TagLib') AS source_id, concat(p, 'custom_tag:ui', m, ':badge') AS target, CAST(3 AS BIGINT) AS line, 'EXACT' AS confidence FROM s""")
def taglibs(spark, sf_dir):
    return _linked(code_graph.declared_edges(_declared(_groovy(spark, sf_dir, TAGLIB, "grails-app/taglib/Ui{k}TagLib.groovy", "grails_taglib"))), "DEFINES_TAG")


@query(f"{S} SELECT concat(p, 'job:Sync', k, 'Job') AS id, 'job' AS kind, concat('Sync', k, 'Job') AS name, concat('Sync', k, 'Job') AS fqn, true AS has_cron FROM s")
def jobs(spark, sf_dir):
    found = _said(code_graph.code_symbols(_declared(_groovy(spark, sf_dir, JOB, "grails-app/jobs/Sync{k}Job.groovy", "grails_job"))), "job", triggers="triggers")
    return found.select("id", "kind", "name", "fqn", F.contains("triggers", F.lit("cron name: 'n")).alias("has_cron"))


@query(f"""{S} SELECT concat(p, 'url_mapping:/s', k, '/$id') AS id, 'url_mapping' AS kind, concat('/s', k, '/$id') AS name, concat('/s', k, '/$id') AS fqn, concat('supply', m) AS controller, 'show' AS action, NULL AS view FROM s
    UNION ALL SELECT concat(p, 'url_mapping:home', k), 'url_mapping', concat('home', k), concat('/h', k), NULL, NULL, '/index' FROM s
    UNION ALL SELECT concat(p, 'url_param:/s', k, '/$id#id'), 'url_param', 'id', concat('/s', k, '/$id#id'), NULL, NULL, NULL FROM s""")
def url_mappings(spark, sf_dir):
    files = _groovy(spark, sf_dir, URLS, "grails-app/conf/{k}/UrlMappings.groovy", "grails_urlmappings")
    return _said(code_graph.configured(files, _declared(files))[0], controller="controller", action="action", view="view")


def _applied(spark, sf_dir, template, path, kind, *types):
    files = _groovy(spark, sf_dir, template, path, kind)
    return _linked(code_graph.configured(files, _declared(files))[1], *types)


@query(f"""{S} SELECT 'MAPS_TO' AS type, concat(p, 'url_mapping:/s', k, '/$id') AS source_id, concat('controller:supply', m, '|action:show') AS target, CAST(3 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM s
    UNION ALL SELECT 'ACCEPTS_PARAM', concat(p, 'url_mapping:/s', k, '/$id'), concat(p, 'url_param:/s', k, '/$id#id'), 3, 'EXACT' FROM s""")
def url_mapping_edges(spark, sf_dir):
    return _applied(spark, sf_dir, URLS, "grails-app/conf/{k}/UrlMappings.groovy", "grails_urlmappings")


@query(f"""{S} SELECT 'APPLIES_TO' AS type, concat(p, 'filter:all', k) AS source_id, 'all' AS target, CAST(3 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM s
    UNION ALL SELECT 'APPLIES_TO', concat(p, 'filter:some', k), concat('controller:supply', m, '|action:save'), 5, 'UNRESOLVED' FROM s""")
def filters(spark, sf_dir):
    return _applied(spark, sf_dir, FILTERS, "grails-app/conf/Auth{k}Filters.groovy", "grails_filters")


@query(f"""{S}, o AS (SELECT *, concat(p, 'interceptor:Guard', k, 'Interceptor') AS own FROM s) SELECT 'APPLIES_TO' AS type, own AS source_id, concat('controller:supply', m) AS target, CAST(3 AS BIGINT) AS line, 'LIKELY' AS confidence FROM o
    UNION ALL SELECT 'APPLIES_TO', own, 'all', 4, 'HEURISTIC' FROM o""")
def interceptors(spark, sf_dir):
    return _applied(spark, sf_dir, INTERCEPTOR, "grails-app/controllers/Guard{k}Interceptor.groovy", "grails_interceptor", "APPLIES_TO")


@query(f"{S} SELECT 'PROVIDES' AS type, concat(p, 'bean:mailer', k) AS source_id, concat('class:com.x.Mailer', m) AS target, CAST(2 AS BIGINT) AS line, 'EXACT' AS confidence FROM s")
def spring_beans(spark, sf_dir):
    return _applied(spark, sf_dir, BEANS, "grails-app/conf/spring/b{k}.groovy", "grails_spring_dsl")


@query(f"{S} SELECT '{PROJECT}:bootstrap:BootStrap' AS id, 'bootstrap' AS kind, 'BootStrap' AS name, 'BootStrap' AS fqn, 'true' AS has_init, 'false' AS has_destroy FROM s LIMIT 1")
def bootstraps(spark, sf_dir):
    return _said(code_graph.code_symbols(_declared(_groovy(spark, sf_dir, BOOTSTRAP, "grails-app/conf/{k}/BootStrap.groovy", "grails_bootstrap"))), "bootstrap", has_init="has_init", has_destroy="has_destroy")


@query(f"""{S} SELECT concat(p, 'plugin_dep:tomcat', k) AS id, 'grails_plugin_dep' AS kind, concat('tomcat', k) AS name, concat('tomcat', k) AS fqn, concat('7.0.', m) AS version, 'build' AS scope FROM s
    UNION ALL SELECT concat(p, 'plugin_dep:mail', k), 'grails_plugin_dep', concat('mail', k), concat('mail', k), '1.0', 'compile' FROM s""")
def build_plugins(spark, sf_dir):
    files = _groovy(spark, sf_dir, PLUGINS, "grails-app/conf/{k}/BuildConfig.groovy", "grails_buildconfig")
    return _said(code_graph.configured(files, _declared(files))[0], version="version", scope="scope")


@query(f"""{S}, o AS (SELECT *, concat('com.g.Plain', k) AS own FROM s) SELECT concat(p, 'interface:', own) AS id, 'interface' AS kind, concat('Plain', k) AS name, own AS fqn, 'public' AS visibility, CAST(3 AS BIGINT) AS line_start FROM o
    UNION ALL SELECT concat(p, kind, ':', own, '#', x), kind, split_part(x, '(', 1), concat(own, '#', x), v, l FROM o, (VALUES ('field', 'title', 'public', 4), ('field', 'LIMIT', 'public', 5), ('method', 'go(int,def)', 'public', 6), ('method', 'stop()', 'protected', 7)) t(kind, x, v, l)""")
def groovy_classes(spark, sf_dir):
    found = code_graph.code_symbols(_declared(_groovy(spark, sf_dir, GENERIC, "src/main/groovy/Plain{k}.groovy", "plain_groovy")))
    return _said(found, visibility="visibility").join(found.select("id", "line_start"), "id")


# --- pages


def _gsp(spark, sf_dir):
    return views.parse_gsp(written(spark, sf_dir, "part", "p_partkey", GSP, "grails-app/views/part/p{k}.gsp", "gsp_view", "gsp"))


def _jsp(spark, sf_dir):
    return views.parse_jsp(written(spark, sf_dir, "part", "p_partkey", JSP, "web-app/p{k}.jsp", "jsp_view", "jsp"))


@query(f"{P} SELECT concat('grails-app/views/part/p', k, '.gsp') AS path, concat('main', m) AS layout, concat('Part ', k) AS static_text, 'items,total' AS variables, concat('/tags/t', m) AS taglib, 'int n = 1' AS scriptlet, 'n' AS expression FROM t")
def gsp_pages(spark, sf_dir):
    joined = lambda c: F.trim(F.concat_ws(",", c))
    return _gsp(spark, sf_dir).select("path", "layout", "static_text", joined("model_variables").alias("variables"), joined("taglibs").alias("taglib"), joined("scriptlets").alias("scriptlet"), joined("expressions").alias("expression"))


@query(f"""{P}, g AS (SELECT *, concat(p, 'gsp:grails-app/views/part/p', k, '.gsp') AS own FROM t)
    SELECT 'USES_LAYOUT' AS type, own AS source_id, concat('layout:main', m) AS target, CAST(1 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM g
    UNION ALL SELECT 'INCLUDES_TEMPLATE', own, concat('template:row', m), 7, 'UNRESOLVED' FROM g
    UNION ALL SELECT 'USES_TAG', own, concat('tag:', x), l, 'UNRESOLVED' FROM g, (VALUES ('g:each', 4), ('g:link', 5), ('g:render', 7), ('f:field', 8)) v(x, l)
    UNION ALL SELECT 'LINKS_TO', own, concat('action:show', m, '|controller:part'), 5, 'UNRESOLVED' FROM g""")
def gsp_edges(spark, sf_dir):
    return _linked(views.gsp_edges(_gsp(spark, sf_dir)))


@query(f"{P} SELECT concat('grails-app/views/part/p', k, '.gsp') AS path, CAST(5 AS BIGINT) AS line, concat('show', m) AS action, 'part' AS controller, NULL AS uri FROM t")
def gsp_links(spark, sf_dir):
    return views.gsp_links(_gsp(spark, sf_dir)).select("path", "line", "action", "controller", "uri")


@query(f"{P} SELECT concat('web-app/p', k, '.jsp') AS path, 'page,taglib,include' AS directives, concat('/part', k, '.jsp,/head', m, '.jspf') AS includes, concat('/end', m, '.jsp') AS forwards, 'part.name' AS el, concat(k) AS expression, 'code();' AS scriptlet FROM t")
def jsp_pages(spark, sf_dir):
    joined = lambda c: F.trim(F.concat_ws(",", c))
    named = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["target"]))
    return _jsp(spark, sf_dir).select("path", joined("directives").alias("directives"), named("includes").alias("includes"), named("forwards").alias("forwards"), joined("el").alias("el"), joined("expressions").alias("expression"), joined("scriptlets").alias("scriptlet"))


@query(f"""{P}, j AS (SELECT *, concat(p, 'jsp:web-app/p', k, '.jsp') AS own FROM t)
    SELECT 'JSP_INCLUDES' AS type, own AS source_id, concat('include:/part', k, '.jsp') AS target, CAST(4 AS BIGINT) AS line, 'UNRESOLVED' AS confidence FROM j
    UNION ALL SELECT 'JSP_INCLUDES', own, concat('include:/head', m, '.jspf'), 3, 'UNRESOLVED' FROM j
    UNION ALL SELECT 'JSP_FORWARDS', own, concat('forward:/end', m, '.jsp'), 5, 'UNRESOLVED' FROM j
    UNION ALL SELECT 'USES_TAGLIB', own, concat('taglib:c:/tags/c', m), 2, 'UNRESOLVED' FROM j""")
def jsp_edges(spark, sf_dir):
    return _linked(views.jsp_edges(_jsp(spark, sf_dir)))


# --- configuration


def _properties(spark, sf_dir):
    return configs.properties(written(spark, sf_dir, "orders", "o_orderkey", PROPERTIES, "conf/o{k}.properties", "properties_config", "properties"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS m, concat('conf/o', o_orderkey, '.properties') AS path FROM orders)
    SELECT path, 'order.key' AS key, concat('n', k) AS value, CAST(6 AS BIGINT) - 1 AS line FROM o UNION ALL SELECT path, 'order.token', concat('s', k), 3 FROM o UNION ALL SELECT path, 'order.note', concat('a b', m), 4 FROM o
    UNION ALL SELECT path, 'spring.datasource.url', concat('jdbc:y', m), 6 FROM o UNION ALL SELECT path, 'jdbc.user', concat('u', k), 7 FROM o""")
def properties_files(spark, sf_dir):
    """The last assignment of a key counts; lines are counted after continued ones are joined."""
    return _properties(spark, sf_dir).select("path", "key", "value", "line")


@query("SELECT concat('conf/o', o_orderkey, '.properties') AS path, concat('jdbc:y', o_orderkey % 7) AS url, NULL AS driver, concat('u', o_orderkey) AS username, NULL AS password, NULL AS dialect FROM orders")
def database_settings(spark, sf_dir):
    return configs.database(_properties(spark, sf_dir)).drop("project_id")


@query(f"""{S}, y AS (SELECT *, concat('conf/s', k, '.yml') AS path FROM s) SELECT path, 'spring.profiles' AS key, concat('dev', m, ', test') AS value, 'str' AS type FROM y
    UNION ALL SELECT path, 'spring.config.activate.on-profile', concat('live', k), 'str' FROM y UNION ALL SELECT path, 'list', concat(k, ', ', m), 'list' FROM y UNION ALL SELECT path, 'none', '[]', 'list' FROM y
    UNION ALL SELECT path, 'deep.password', 'hush', 'str' FROM y UNION ALL SELECT path, 'later', 'true', 'bool' FROM y""")
def yaml_files(spark, sf_dir):
    return configs.yaml_keys(written(spark, sf_dir, "supplier", "s_suppkey", YAML, "conf/s{k}.yml", "yaml_config", "yaml")).drop("project_id")


@query(f"{S} SELECT concat('conf/s', k, '.yml') AS path, unnest([concat('dev', m), 'test', concat('live', k)]) AS profile FROM s")
def spring_profiles(spark, sf_dir):
    return configs.profiles(configs.yaml_keys(written(spark, sf_dir, "supplier", "s_suppkey", YAML, "conf/s{k}.yml", "yaml_config", "yaml"))).drop("project_id")


@query(f"""{S}, g AS (SELECT *, concat('grails-app/conf/', k, '/Config.groovy') AS path FROM s) SELECT path, 'app.name' AS key, concat('supply', k) AS value, 'str' AS type FROM g UNION ALL SELECT path, 'dataSource.url', concat('jdbc:x', m), 'str' FROM g
    UNION ALL SELECT path, 'dataSource.password', 'hush', 'str' FROM g UNION ALL SELECT path, 'dataSource.pool.size', concat(k), 'int' FROM g""")
def groovy_config(spark, sf_dir):
    return configs.groovy_keys(_groovy(spark, sf_dir, SCRIPT, "grails-app/conf/{k}/Config.groovy", "grails_config")).drop("project_id")


@query(f"""{S}, g AS (SELECT *, concat('grails-app/conf/', k, '/Config.groovy') AS path FROM s)
    SELECT concat(p, 'config_key:', path, '#', key) AS id, 'config_key' AS kind, regexp_extract(key, '[^.]*$') AS name, key AS fqn, CASE WHEN key = 'dataSource.password' THEN '[REDACTED]' WHEN key = 'app.name' THEN concat('supply', k) WHEN key = 'dataSource.url' THEN concat('jdbc:x', m) ELSE concat(k) END AS value,
        CASE WHEN key = 'dataSource.password' THEN 'true' ELSE 'false' END AS redacted, CASE WHEN key = 'dataSource.pool.size' THEN 'int' ELSE 'str' END AS type
    FROM g, (VALUES ('app.name'), ('dataSource.url'), ('dataSource.password'), ('dataSource.pool.size')) v(key)""")
def config_key_symbols(spark, sf_dir):
    keys = configs.groovy_keys(_groovy(spark, sf_dir, SCRIPT, "grails-app/conf/{k}/Config.groovy", "grails_config"))
    return _said(configs.config_symbols(keys), value="value", redacted="is_redacted", type="original_type")


def _xml(spark, sf_dir):
    return written(spark, sf_dir, "supplier", "s_suppkey", XML, "conf/s{k}.xml", "xml_config", "xml")


@query(f"{S} SELECT concat('conf/s', k, '.xml') AS path, '{{http://b/beans}}beans' AS root_tag, 'http://b/beans' AS own_namespace, 'http://b/p' AS p_namespace, CAST(6 AS BIGINT) AS elements_count, CAST(2 AS INTEGER) AS beans FROM s")
def xml_files(spark, sf_dir):
    name = lambda key: F.try_element_at("namespaces", F.lit(key))
    return configs.parse_xml(_xml(spark, sf_dir)).select("path", "root_tag", name("default").alias("own_namespace"), name("p").alias("p_namespace"), "elements_count", F.size("beans").alias("beans"))


@query(f"""{S} SELECT concat('store', k) AS id, 'bean' AS type, concat('com.x.Store', m) AS class, 'prototype' AS scope, true AS lazy_init, concat('mailer=mailer', m, ',size=', k) AS properties, concat('0=v', k) AS arguments, '' AS alias FROM s
    UNION ALL SELECT '', 'alias', '', 'singleton', false, '', '', concat('shop', k) FROM s""")
def xml_beans(spark, sf_dir):
    beans = configs.xml_beans(configs.parse_xml(_xml(spark, sf_dir)))
    said = lambda rows, name: F.concat_ws(",", F.transform(rows, lambda x: F.concat(x[name], F.lit("="), F.concat(x["ref"], x["value"]))))
    return beans.select("id", "type", "class", "scope", "lazy_init", said("properties", "name").alias("properties"), said("constructor_args", "index").alias("arguments"), "alias")


@query(f"{S} SELECT concat('conf/s', k, '.xml') AS path, concat('mailer,size') AS names FROM s")
def xml_xpath(spark, sf_dir):
    return configs.xpath_lookup(_xml(spark, sf_dir), "//property/@name").select("path", F.concat_ws(",", "found").alias("names"))


@query(f"{S} SELECT concat(p, 'bean:store', k) AS id, 'bean' AS kind, concat('store', k) AS name, concat('com.x.Store', m) AS fqn FROM s UNION ALL SELECT concat(p, 'bean:shop', k), 'bean', concat('shop', k), concat('shop', k) FROM s")
def xml_bean_symbols(spark, sf_dir):
    return _said(configs.bean_symbols(configs.xml_beans(configs.parse_xml(_xml(spark, sf_dir)))))
