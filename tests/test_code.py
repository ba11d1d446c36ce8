"""Source code as symbols and edges: declarations, bodies, application files and their resolution."""

from __future__ import annotations

from terrane.engine import Engine
from terrane.sources import code, code_graph

JAVA = """package com.x.service;

import com.x.domain.User;
import java.util.*;

/** Serves
 *  users. */
@Service("users")
public class UserService extends Base<User> implements Finder, java.io.Closeable {
    private static final String NOTE = "not { a brace } // nor a comment";
    /* private int gone; */
    @Autowired @Qualifier("main")
    private UserRepository repository;
    Map<String, List<User>> cache = new HashMap<>();

    public UserService(UserRepository repository) { this.repository = repository; }

    /** Finds. */
    @Cacheable("users")
    public User find(Long id, @Valid List<String> names) {
        if (id == null) { return null; }
        audit("calls nothing(here)");
        restTemplate.getForObject("http://api/u", String.class);
        return new User(id, repository.load(id).getName());
    }

    void audit(String text) {
        rabbitTemplate.convertAndSend("logs", text);
    }

    abstract int open();
    class Inner { int hidden; }
}

enum Colour { RED, GREEN; int code; }
interface Finder { User find(Long id); }
"""

CONTROLLER = """package com.x

import com.x.service.UserService

class UserController {
    static allowedMethods = [save: 'POST']
    UserService userService
    def index() {
        redirect action: 'list'
    }
    @Secured(['ADMIN'])
    def list() {
        def users = User.findAllByName(params.name)
        render(view: 'list', model: [users: users])
    }
    def save = { SaveCommand cmd ->
        userService.audit('x')
        render status: 404, contentType: 'application/json'
    }
    def bind(SaveCommand cmd)
    {
        chain controller: 'loan', action: 'open'
    }
    private _hidden() { [1].each { it } }
}
"""


def _files(spark, *rows):
    schema = "project_id string, path string, artifact_type string, language string, content_hash string, text string"
    return spark.createDataFrame([("p", path, kind, path.rsplit(".", 1)[-1], "h", text) for path, kind, text in rows], schema)


def _declared(spark, *rows):
    return code_graph.described(code.declarations(_files(spark, *rows)))


def _found(edges):
    return {(r["type"], r["source_id"].split(":", 1)[1], (r["target_id"] or r["target_hint"]), r["line"]) for r in edges.collect()}


def test_java_declarations(spark):
    d = _declared(spark, ("a.java", "plain_java", JAVA))
    got = {r["id"]: r for r in code_graph.code_symbols(d).collect()}
    own = "com.x.service.UserService"
    assert set(got) == {
        f"p:class:{own}", f"p:field:{own}#NOTE", f"p:field:{own}#repository", f"p:field:{own}#cache", f"p:constructor:{own}#UserService(UserRepository)", f"p:method:{own}#find(Long,List)", f"p:method:{own}#audit(String)",
        f"p:method:{own}#open()", "p:enum:com.x.service.Colour", "p:field:com.x.service.Colour#code", "p:interface:com.x.service.Finder", "p:method:com.x.service.Finder#find(Long)",
    }
    assert got[f"p:class:{own}"]["docstring"] == "Serves\nusers." and (got[f"p:class:{own}"]["line_start"], got[f"p:class:{own}"]["line_end"]) == (8, 33)
    held = got[f"p:field:{own}#repository"]["properties"]
    assert (held["injection_point"], held["qualifier_hint"], held["visibility"], held["type_hint"]) == ("true", "main", "private", "UserRepository")
    assert got[f"p:method:{own}#find(Long,List)"]["properties"]["return_type"] == "User"
    assert got[f"p:field:{own}#NOTE"]["properties"]["is_final"] == "true"


def test_java_edges(spark):
    d = _declared(spark, ("a.java", "plain_java", JAVA))
    own = "com.x.service.UserService"
    heads = _found(code_graph.declared_edges(d))
    assert ("EXTENDS", f"class:{own}", "class:Base|file:a.java|imports:com.x.domain.User,java.util.*", 8) in heads
    assert {t[2].split("|")[0] for t in heads if t[0] == "IMPLEMENTS"} == {"interface:Finder", "interface:java.io.Closeable"}
    assert ("INJECTS", f"field:{own}#repository", f"service:repository|class:{own}|file:a.java|type:UserRepository|qualifier:main", 12) in heads
    assert ("USES_TYPE", f"field:{own}#cache", "type:Map", 14) in heads and ("ANNOTATED_WITH", f"class:{own}", 'annotation:@Service("users")', 8) in heads
    lines = code_graph.body_lines(d)
    find = f"method:{own}#find(Long,List)"
    assert {t for t in _found(code_graph.body_edges(lines)) if t[1] == find} == {
        ("CALLS", find, "method:audit|receiver:|file:a.java", 22), ("CALLS", find, "method:getForObject|receiver:restTemplate|file:a.java", 23), ("INSTANTIATES", find, "class:User|file:a.java", 24),
        ("CALLS", find, "method:load|receiver:repository|file:a.java", 24), ("CALLS", find, "method:getName|receiver:?|file:a.java", 24),
    }
    nodes, edges = code_graph.used(lines, d)
    assert {r["kind"] for r in nodes.collect()} == {"external_http", "mq_exchange", "cache_region"}
    assert _found(edges) == {("CALLS_EXTERNAL", find, "p:external_http:http://api/u_23", 23), ("PUBLISHES_TO", f"method:{own}#audit(String)", "p:mq_exchange:logs", 28), ("CACHED_BY", find, "p:cache_region:users", 19)}


def test_controller(spark):
    d = _declared(spark, ("c.groovy", "grails_controller", CONTROLLER))
    own, name = "com.x.UserController", lambda a: f"action:com.x.UserController#{a}"
    kinds = {r["name"]: r["kind"] for r in code_graph.code_symbols(d).collect()}
    assert kinds == {"UserController": "controller", "allowedMethods": "field", "userService": "field", "index": "action", "list": "action", "save": "action", "bind": "action", "_hidden": "method"}
    assert ("BINDS_COMMAND", name("bind"), "command:SaveCommand", 20) in _found(code_graph.declared_edges(d))
    found = {t for t in _found(code_graph.body_edges(code_graph.body_lines(d))) if t[0] != "CALLS"}
    assert found == {
        ("REDIRECTS_TO", name("index"), "action:list|source_controller:User", 9), ("QUERIES_DOMAIN", name("list"), "domain:User", 13), ("RENDERS", name("list"), "view:list|controller:User", 14),
        ("RETURNS_STATUS", name("save"), "status:404", 18), ("RETURNS_FORMAT", name("save"), "format:json", 18), ("CHAINS_TO", name("bind"), "action:open|controller:loan", 22),
    }
    nodes, edges = code_graph.used(code_graph.body_lines(d), d)
    assert [r["name"] for r in nodes.collect()] == ["name"] and ("ACCEPTS_PARAM", name("list"), f"p:query_param:{own}#list#name", 13) in _found(edges)


def test_grails_artifacts(spark):
    domain = "package com.x\nclass Loan {\n  String title\n  static hasMany = [items: Item, notes: com.x.Note]\n  static belongsTo = [User]\n  static mapping = {\n    table 'loans'\n  }\n}\n"
    taglib = "class UiTagLib {\n  static namespace = 'ui'\n  def badge = { attrs, body -> out << 'x' }\n}\n"
    guard = "class AuthInterceptor {\n  AuthInterceptor() {\n    match(controller: 'loan', action: '*')\n    matchAll().excludes(controller: 'login')\n  }\n}\n"
    service = "@Transactional\nclass LoanService {\n  def approve(Loan loan) { loan.save() }\n}\n"
    d = _declared(spark, ("Loan.groovy", "grails_domain", domain), ("UiTagLib.groovy", "grails_taglib", taglib), ("AuthInterceptor.groovy", "grails_interceptor", guard), ("LoanService.groovy", "grails_service", service))
    got = {r["id"]: r for r in code_graph.code_symbols(d).collect()}
    assert got["p:domain:com.x.Loan"]["properties"]["table_name"] == "loans" and got["p:custom_tag:ui:badge"]["kind"] == "custom_tag"
    held = got["p:service:LoanService"]["properties"]
    assert (held["bean_name"], held["transactional"]) == ("loanService", "true") and "p:method:LoanService#approve" in got
    heads = _found(code_graph.declared_edges(d))
    assert {t[2] for t in heads if t[0] == "HAS_RELATION"} == {"domain:Item", "domain:com.x.Note", "domain:User"}
    assert ("DEFINES_TAG", "taglib:UiTagLib", "p:custom_tag:ui:badge", 3) in heads
    _, edges = code_graph.configured(_files(spark, ("x.groovy", "plain_groovy", "")), d)
    assert {(r["target_hint"], r["confidence"]) for r in edges.collect()} == {("controller:loan", "LIKELY"), ("all", "HEURISTIC")}


def test_application_files(spark):
    urls = 'class UrlMappings {\n  static mappings = {\n    "/loan/$id"(controller: "loan", action: "show")\n    name home: "/"(view: "/index")\n    "/api/$kind?" {\n      controller = "api"\n    }\n    // "/old"(controller: "old")\n    "500"(view: "/error")\n  }\n}\n'
    filters = "class AuthFilters {\n  def filters = {\n    login(controller: '*', action: '*') {\n      before = { true }\n    }\n    loans(controller: 'loan', action: 'save') { }\n  }\n}\n"
    beans = "beans = {\n  mailer(com.x.Mailer) {\n    host = 'a'\n  }\n  clock(Clock)\n}\n"
    plugins = 'plugins {\n  build ":tomcat:7.0.1"\n  compile(":mail:1.0")\n  ":cache:2"\n}\n'
    files = _files(spark, ("UrlMappings.groovy", "grails_urlmappings", urls), ("AuthFilters.groovy", "grails_filters", filters), ("resources.groovy", "grails_spring_dsl", beans), ("BuildConfig.groovy", "grails_buildconfig", plugins))
    nodes, edges = code_graph.configured(files, code_graph.described(code.declarations(files)))
    ids = {r["id"][2:]: r["properties"] for r in nodes.collect()}
    assert set(ids) == {
        "url_mapping:/loan/$id", "url_mapping:home", "url_mapping:/api/$kind?", "url_mapping:500", "url_param:/loan/$id#id", "url_param:/api/$kind?#kind", "filter:login", "filter:loans", "bean:mailer", "bean:clock",
        "plugin_dep:tomcat", "plugin_dep:mail", "plugin_dep:cache",
    }
    assert ids["plugin_dep:tomcat"] == {"version": "7.0.1", "scope": "build"} and ids["plugin_dep:cache"]["scope"] == "compile"
    found = {t[:3] for t in _found(edges)}
    assert found >= {("MAPS_TO", "url_mapping:/loan/$id", "controller:loan|action:show"), ("MAPS_TO", "url_mapping:/api/$kind?", "controller:api"), ("APPLIES_TO", "filter:login", "all"), ("APPLIES_TO", "filter:loans", "controller:loan|action:save"), ("PROVIDES", "bean:mailer", "class:com.x.Mailer")}


def test_odd_source(spark):
    odd = ["", None, "}}}} ) class", "class A { void b() {", "class {", "/* open", 'class A { String s = "', "class A {\n" * 300, "def x = 1\n" * 2000]
    rows = [(f"{i}.{language}", f"plain_{language}", text) for i, text in enumerate(odd) for language in ("groovy", "java")]
    d = _declared(spark, *rows, ("b.java", "plain_java", "class Good { int a; }"))
    assert {r["name"] for r in code_graph.code_symbols(d).collect()} == {"Good", "a", "A", "b", "s"}
    assert code_graph.body_edges(code_graph.body_lines(d)).count() == 0


def test_code_in_the_engine(spark, tmp_path):
    root = tmp_path / "project"
    files = {
        "build.gradle": "// build", "grails-app/controllers/com/x/UserController.groovy": CONTROLLER, "grails-app/services/com/x/service/UserService.groovy": "package com.x.service\nclass UserService {\n  def audit(String t) { helper() }\n  def helper() { 1 }\n}\n",
        "grails-app/domain/com/x/User.groovy": "package com.x\nclass User {\n  String name\n}\n", "grails-app/views/user/list.gsp": "<p/>", "grails-app/conf/UrlMappings.groovy": 'class UrlMappings {\n  static mappings = {\n    "/u"(controller: "user", action: "list")\n  }\n}\n',
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    engine = Engine(spark, str(tmp_path / "store"))
    pid = engine.index(str(root))["project_id"]
    edges = {(r["type"], r["source_id"][len(pid) + 1 :], (r["target_id"] or "")[len(pid) + 1 :], r["confidence"]) for r in engine.store.read("edges").collect()}
    action = "action:com.x.UserController#"
    assert edges >= {
        ("REDIRECTS_TO", f"{action}index", f"{action}list", "EXACT"), ("RENDERS", f"{action}list", "gsp:grails-app/views/user/list.gsp", "EXACT"), ("QUERIES_DOMAIN", f"{action}list", "domain:com.x.User", "LIKELY"),
        ("CALLS", f"{action}save", "method:com.x.service.UserService#audit", "LIKELY"), ("CALLS", "method:com.x.service.UserService#audit", "method:com.x.service.UserService#helper", "EXACT"),
        ("INJECTS", "field:com.x.UserController#userService", "service:com.x.service.UserService", "EXACT"), ("MAPS_TO", "url_mapping:/u", f"{action}list", "EXACT"),
    }
