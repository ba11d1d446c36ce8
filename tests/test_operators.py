"""Truth tables of the operators, and the engine over a small project."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrane.engine import Engine
from terrane.functions import paths, text
from terrane.operators import graph, resolve, retrieval, templates
from terrane.operators.diff import snapshot_diff
from terrane.operators.store import transition
from terrane.sources import configs, views

SYMBOLS = "id string, kind string, name string, fqn string, file_path string, line_start long, project_id string, properties map<string,string>"
EDGES = "source_id string, target_id string, target_hint string, type string, file_path string, line long, confidence string"


def column(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("version", "path", "kind"),
    [
        ("3.x", "grails-app/controllers/UserController.groovy", "grails_controller"), ("3.x", "GRAILS-APP/CONTROLLERS/UserController.GROOVY", "grails_controller"), ("3.x", "grails-app\\controllers\\UserController.groovy", "grails_controller"),
        ("3.x", "grails-app/controllers/AuthInterceptor.groovy", "grails_interceptor"), ("3.x", "grails-app/conf/UrlMappings.groovy", "grails_urlmappings"), ("3.x", "grails-app/views/layouts/main.gsp", "gsp_layout"),
        ("3.x", "grails-app/views/user/_form.gsp", "gsp_template"), ("3.x", "grails-app/views/user/show.gsp", "gsp_view"), ("3.x", "web-app/WEB-INF/includes/header.jspf", "jsp_include"), ("3.x", "config/settings.yaml", "yaml_config"),
        ("2.x", "grails-app/conf/Config.groovy", "grails_config"), ("2.x", "grails-app/conf/spring/security.groovy", "grails_spring_dsl"), ("2.x", "web-app/js/app.js", "unknown"), ("unknown", "scripts/deploy.groovy", "unknown"), ("3.x", "", "unknown"), ("3.x", None, "unknown"),
    ],
)
def test_classify(spark, version, path, kind):
    assert column(spark, lambda v: paths.classify(v, F.lit(version))["artifact_type"], path) == [kind]


def test_ignores_and_scopes(spark):
    assert column(spark, lambda v: paths.ignored(v, F.lit("3.x")), "build.gradle", "build/a", "x/node_modules/y", "a.min.js", "outer/a") == [False, True, True, True, False]
    assert column(spark, lambda v: paths.ignored_by(v, ["*.log", "!keep.log", "/top/", "docs/**/x.md"]), "a.log", "b/keep.log", "top/a", "b/top/a", "docs/q/x.md", "docs/x.md") == [True, False, True, False, True, True]
    assert column(spark, lambda v: paths.in_scope(v, "files:a,b"), "a", "b", "c") == [True, True, False]
    with pytest.raises(ValueError, match="unknown scope"):
        paths.in_scope(F.lit("a"), "api:x")


def test_diff_truth_table(spark):
    now = spark.createDataFrame([("p", "new", "h1"), ("p", "changed", "h2"), ("p", "same", "h1"), ("p", "unread", None)], "project_id string, path string, content_hash string")
    then = spark.createDataFrame([("p", "changed", "h1"), ("p", "same", "h1"), ("p", "gone", "h1"), ("p", "unread", None)], "project_id string, path string, content_hash string")
    of = lambda d: {r["path"]: r["status"] for r in d.collect()}
    assert of(snapshot_diff(now, then)) == {"new": "created", "changed": "modified", "same": "unchanged", "gone": "deleted", "unread": "unchanged"}
    assert of(snapshot_diff(now, then, "file:same")) == {"same": "unchanged"}
    assert of(snapshot_diff(now, then, force=True)) == {"new": "modified", "changed": "modified", "same": "modified", "gone": "deleted", "unread": "modified"}


def test_hints_questions_and_lines(spark):
    assert column(spark, lambda v: text.hint(v, "uri"), "uri:http://x|a:b", "flag", "uri:1|uri:2", None) == ["http://x", None, "2", None]
    asked = ["Where is LoanService defined?", "What calls approve?", "Follow the request", "What does LoanController use?", "List all controllers", "How does approval work?", "Where is the code that what calls X", "Which view is rendered?", None]
    assert column(spark, text.intent, *asked) == ["Location", "Impact", "Trace", "Relation", "Discovery", "Logic", "Location", "Logic", "Logic"]
    got = column(spark, text.entities, "Does 'x y' get /a/b/ from LoanService?")[0]
    assert got.asDict() == {"symbol_names": ["Does", "LoanService"], "file_paths": ["/a/b/"], "http_methods": ["get"], "literals": ["x y"]}
    assert column(spark, lambda v: text.line_of(v, F.lit("x")), "a\nb\nx", "none") == [3, 1]
    assert column(spark, text.is_secret, "db.PASSWORD", "plain") == [True, False]


def _symbols(spark):
    rows = [
        ("c1", "class", "LoanService", "com.x.LoanService", "s", 1, "p", {"bean_name": "loanService"}), ("m1", "method", "approve", "com.x.LoanService#approve(Loan)", "s", 3, "p", None), ("m2", "method", "approve", "com.x.LoanService#approve(Loan,int)", "s", 9, "p", None),
        ("m3", "method", "once", "com.x.Util#once()", "u", 2, "p", None), ("m4", "method", "save", "com.x.LoanService#save()", "s", 20, "p", None), ("m5", "method", "save", "com.x.Util#save()", "u", 5, "p", None),
        ("v1", "gsp_view", "show.gsp", "v1", "grails-app/views/user/show.gsp", 1, "p", None), ("l1", "gsp_layout", "main.gsp", "l1", "grails-app/views/layouts/main.gsp", 1, "p", None), ("a1", "action", "list", "com.x.LoanController#list", "c", 1, "p", None),
    ]
    return spark.createDataFrame(rows, SYMBOLS)


def _resolved(frame):
    return {r["line"]: (r["target_id"], r["confidence"], r["warning_code"]) for r in frame.collect()}


def _hints(spark, *hints, source="m4", file="s"):
    return spark.createDataFrame([(source, None, h, "T", file, i, None) for i, h in enumerate(hints)], EDGES)


def test_resolver_tiers(spark):
    symbols = _symbols(spark)
    imports = spark.createDataFrame([("s", 0, "com.x.Util"), ("s", 1, "com.x.LoanService")], "file_path string, position int, import string")
    calls = _hints(spark, "method:approve|receiver:", "method:save|receiver:loanService", "method:save|receiver:Util", "method:once|receiver:x", "method:save|receiver:x", "method:none|receiver:this")
    assert _resolved(resolve.resolve_calls(calls, symbols, imports)) == {0: ("m1", "EXACT", None), 1: ("m4", "LIKELY", None), 2: ("m5", "EXACT", None), 3: ("m3", "HEURISTIC", None), 4: (None, "UNRESOLVED", None), 5: (None, "UNRESOLVED", None)}
    injects = _hints(spark, "qualifier:loanService", "type:com.x.LoanService", "type:LoanService", "type:Missing|service:loanService", "service:loanService")
    assert _resolved(resolve.resolve_injects(injects, symbols, imports)) == {0: ("c1", "EXACT", None), 1: ("c1", "EXACT", None), 2: ("c1", "EXACT", None), 3: (None, "UNRESOLVED", "unresolved_di"), 4: ("c1", "LIKELY", None)}
    types = _hints(spark, "type:com.x.LoanService", "type:LoanService", "type:save")
    assert [v[1] for _, v in sorted(_resolved(resolve.resolve_types(types, symbols)).items())] == ["EXACT", "LIKELY", "UNRESOLVED"]
    assert _resolved(resolve.resolve_renders(_hints(spark, "view:show|controller:User", "view:show|controller:Other", "view:none"), symbols)) == {0: ("v1", "EXACT", None), 1: ("v1", "LIKELY", None), 2: (None, "UNRESOLVED", "missing_view")}
    mappings = spark.createDataFrame([("/loan/list", "a1")], "uri string, id string")
    redirects = _hints(spark, "action:list|controller:loan", "uri:/loan/list", "action:list", file="grails-app/views/loan/x.gsp")
    assert {k: v[:2] for k, v in _resolved(resolve.resolve_redirects(redirects, symbols, mappings)).items()} == {0: ("a1", "EXACT"), 1: ("a1", "LIKELY"), 2: ("a1", "LIKELY")}
    assert _resolved(resolve.resolve_layouts(_hints(spark, "layout:main", "layout:zzz"), symbols)) == {0: ("l1", "EXACT", None), 1: (None, "UNRESOLVED", "missing_layout")}


def test_graph_maintenance(spark):
    symbols = _symbols(spark).drop("properties")
    edge = [("m4", "m1", "", "CALLS", "s", 1, "EXACT"), ("m4", "zz", "", "CALLS", "s", 2, "EXACT"), ("m4", "zz", "", "INJECTS", "s", 3, "LIKELY"), ("zz", "m1", "", "CALLS", "s", 4, "EXACT"), ("m4", "m1", "", "CALLS", "gone", 5, "EXACT")]
    swept = {r["line"]: (r["action"], r["target_id"], r["confidence"], r["warning_code"]) for r in graph.dangling_sweep(spark.createDataFrame(edge, EDGES), symbols, spark.createDataFrame([("gone",)], "file_path string")).collect()}
    assert swept == {1: ("keep", "m1", "EXACT", None), 2: ("downgrade", None, "UNRESOLVED", "ambiguous_call"), 3: ("keep", "zz", "LIKELY", None), 4: ("delete", "m1", "EXACT", None), 5: ("delete", "m1", "EXACT", None)}
    new = symbols.filter("id in ('m1', 'm3')").withColumn("name", F.lit("renamed"))
    once = graph.upsert_nodes(symbols.withColumn("last_run_id", F.lit("r1")), new.withColumn("last_run_id", F.lit("r2")), "r2")
    assert sorted(map(str, graph.upsert_nodes(once, new.withColumn("last_run_id", F.lit("r2")), "r2").collect())) == sorted(map(str, once.collect()))
    assert graph.upsert_counts(symbols, new.unionByName(new.limit(1).withColumn("id", F.lit("x")))).first().asDict() == {"inserted": 1, "updated": 2}
    old = spark.createDataFrame([], EDGES + ", last_run_id string")
    kept = graph.upsert_edges(old, spark.createDataFrame([*edge[:1] * 2, ("", "m1", "", "CALLS", "s", 9, None), ("m4", "", "h", "CALLS", "s", 6, None)], EDGES), symbols, "r2")
    assert sorted((r["line"], r["target_id"], r["confidence"]) for r in kept.collect()) == [(1, "m1", "EXACT"), (6, None, "UNRESOLVED")]
    left, edges = graph.delete_files(symbols, spark.createDataFrame(edge, EDGES), spark.createDataFrame([("s",)], "file_path string"))
    assert left.filter("file_path = 's'").count() == 0 and edges.filter("source_id = 'm4' or target_id = 'm1'").count() == 0


def test_traversal_with_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("c", "d", "CALLS"), ("d", "e", "CALLS")], "source_id string, target_id string, type string")
    reached = lambda **k: {r["id"]: r["depth"] for r in templates.traverse(edges, spark.createDataFrame([("a",)], "id string"), **k).collect()}
    assert reached() == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert reached(reverse=True, depth=5) == {"a": 0, "c": 1, "b": 2}
    with pytest.raises(ValueError, match="unknown template"):
        templates.run_template("nothing", edges, edges)


def test_states():
    assert transition("NEW", "RUNNING") == "RUNNING"
    with pytest.raises(ValueError, match="cannot become"):
        transition("NEW", "COMPLETED")


def test_properties(spark):
    source = "# note\n! note\na=1\nb : two words \nc d\\\n   e\nkey\\ x=\\u00e9\\t!\na=2\nempty=\n"
    rows = configs.properties(spark.createDataFrame([("p", "f", source)], "project_id string, path string, text string")).collect()
    assert {r["key"]: r["value"] for r in rows} == {"a": "2", "b": "two words", "c": "de", "key x": "é\t!", "empty": ""}


def test_yaml_and_database(spark):
    source = "spring:\n  profiles: dev, test\n  datasource:\n    url: jdbc:x\n    password: hush\nlist: [1, 2]\nnone: []\n---\nlater: true\n"
    keys = configs.yaml_keys(spark.createDataFrame([("p", "f.yml", source), ("p", "bad.yml", "a: [")], "project_id string, path string, text string"))
    got = {r["key"]: r["value"] for r in keys.collect()}
    assert got == {"spring.profiles": "dev, test", "spring.datasource.url": "jdbc:x", "spring.datasource.password": "hush", "list": "1, 2", "none": "[]", "later": "true"}
    assert sorted(r["profile"] for r in configs.profiles(keys).collect()) == ["dev", "test"]
    row = configs.database(keys).first()
    assert row["url"] == "jdbc:x" and row["password"] == "[REDACTED]"


GSP = """<html><head><meta name="layout" content="main"/></head>
<body><g:each in="${users}" var="u"><g:link action="show" id="${u.id}">x</g:link></g:each>
<g:render template="form"/> <% int i = 0 %> <%= i %> text ${flash} ${users}</body></html>"""


def test_pages(spark):
    row = views.parse_gsp(spark.createDataFrame([("p", "v.gsp", GSP)], "project_id string, path string, text string"))
    got = row.first()
    assert got["layout"] == "main" and [(t["name"], t["line"]) for t in got["tags"]] == [("g:each", 2), ("g:link", 2), ("g:render", 3)]
    assert [(i["target"], i["line"]) for i in got["includes"]] == [("form", 3)]
    assert got["model_variables"] == ["users", "u", "flash"] and got["static_text"] == "x text"
    assert [(r["action"], r["controller"]) for r in views.gsp_links(row).collect()] == [("show", None)]
    jsp = views.parse_jsp(spark.createDataFrame([("p", "v.jsp", '<%@ include file="a.jspf" %>\n<jsp:include page="b.jsp"/><jsp:forward page="c.jsp"/>${x}')], "project_id string, path string, text string")).first()
    assert [i["target"] for i in jsp["includes"]] == ["b.jsp", "a.jspf"] and [f["target"] for f in jsp["forwards"]] == ["c.jsp"] and jsp["el"] == ["x"]


FILES = {
    "build.gradle": "// build", "grails-app/controllers/UserController.groovy": "class UserController {}", "grails-app/services/UserService.groovy": "class UserService {}", "grails-app/views/user/show.gsp": GSP,
    "grails-app/views/layouts/main.gsp": "<html></html>", "grails-app/views/user/_form.gsp": "<p>form</p>", "grails-app/conf/application.yml": "db:\n  password: x\n", ".gitignore": "*.log\n", "a.log": "x", "build/out.groovy": "x",
}


def test_engine(spark, tmp_path):
    root = tmp_path / "project"
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    engine = Engine(spark, str(tmp_path / "store"))
    dry = engine.index(str(root), dry_run=True)
    assert dry["created"] == 8 and dry["version"] == "3.x" and engine.list_projects().count() == 0
    first = engine.index(str(root))
    pid = first["project_id"]
    assert first["file_counts"] == dry["file_counts"] and first["file_counts"]["unknown"] == 1
    before = {t: sorted(map(str, engine.store.read(t).drop("last_run_id").collect())) for t in ("symbols", "edges", "chunks")}
    again = engine.index(str(root))
    assert (again["created"], again["modified"], again["deleted"], again["unchanged"]) == (0, 0, 0, 8)
    assert {t: sorted(map(str, engine.store.read(t).drop("last_run_id").collect())) for t in before} == before
    assert {(r["type"], r["confidence"]) for r in engine.store.read("edges").collect()} >= {("USES_LAYOUT", "EXACT"), ("LINKS_TO", "UNRESOLVED")}
    secret = engine.query(pid, "find_symbol", q="db.password").first()
    assert secret["properties"]["value"] == "[REDACTED]"
    assert engine.ask(pid, "Where is UserService defined?")["nodes"][0]["name"] == "UserService"
    (root / "grails-app/views/layouts/main.gsp").unlink()
    third = engine.index(str(root))
    assert (third["deleted"], third["unchanged"]) == (1, 7)
    assert [r["confidence"] for r in engine.store.read("edges").filter("type = 'USES_LAYOUT'").collect()] == ["UNRESOLVED"]
    assert engine.invalidate(pid, "module:grails-app/views/")["invalidated_files"] == 2
    assert engine.rebuild(pid)["modified"] == 2
    assert engine.status(project_id=pid)["graph_stats"]["nodes"] == engine.store.read("symbols").count() > 0
    assert [r["state"] for r in engine.list_projects().collect()] == ["COMPLETED"]
    assert engine.verify_change(first["run_id"])["new_unresolved_count"] >= 0
    assert engine.change_plan(pid, f"{pid}:service:UserService").count() == 1


def test_store_keeps_what_several_writers_wrote(spark, tmp_path):
    from terrane.operators.store import Conflict, Store

    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    shape = "run_id string, project_id string, state string, stage string, counts map<string,bigint>, warnings array<string>, error string, updated_at timestamp"
    rows = lambda *pairs: spark.createDataFrame([(r, p, "", "", {}, [], None, None) for r, p in pairs], shape)
    held = lambda *projects: sorted((r["run_id"], r["project_id"]) for r in two.read("runs", *projects).collect())
    one.write("runs", rows(("a", "p"), ("b", "q/=é"), ("c", None)))
    base = one.manifest("runs")
    two.write("runs", rows(("d", "q/=é")), "q/=é")
    one.write("runs", rows(("e", "p")), "p", base=base)  # another project than the other writer's
    assert held("p", "q/=é") == [("d", "q/=é"), ("e", "p")] and one.read("runs").count() == 3
    with pytest.raises(Conflict):
        one.write("runs", rows(("f", "q/=é")), "q/=é", base=base)
    with pytest.raises(ValueError):
        one.write("runs", rows(("f", "p")), "q/=é")
    one.MOST_FOLDERS = 2
    for name in "ghi":
        one.append("runs", rows((name, "r")), "r")
    assert held("r") == [("g", "r"), ("h", "r"), ("i", "r")] and sorted(map(len, one.manifest("runs").values())) == [1, 1, 1, 1]
    newest = int(one._versions("runs")[-1][1:-5])
    (tmp_path / f"store/runs/versions/v{newest + 1:012d}.json").write_text('{"half')  # a writer that ended early
    before = held("p", "q/=é", "r")
    two.write("runs", rows(), "p")
    assert one.read("runs").count() == 5 and not held("p")
    assert len(before) == 5 and one.vacuum("runs", keep=1) > 0 and len(one._versions("runs")) == 1
    assert one.vacuum("runs", keep=1, older_than_s=-60) > 0 and held("q/=é", "r") == before[:1] + before[2:]


def test_projects_that_are_written_together_share_a_folder(spark, tmp_path):
    """Not a folder for each of many projects; one that is written alone stands before its shared row, and is not lost with it."""
    from terrane.operators.store import SCHEMAS, Conflict, Store

    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    rows = spark.range(500).selectExpr("concat('p', id) as project_id", "'/r' as root", "'n' as name", "'v' as version", "'IDLE' as state", "3 as index_version", "timestamp_seconds(1000 - id) as last_indexed_at", "'r' as last_run_id")
    one.write("projects", rows)
    assert len(list((tmp_path / "store/projects/rows").glob("**/*.parquet"))) <= rows.rdd.getNumPartitions() and [len(f) for f in one.manifest("projects").values()] == [1]
    base = one.manifest("projects")
    two.set_state("p7", "RUNNING")
    one.replace("projects", one.read("projects", "p8").replace("IDLE", "FAILED", "state"), ["project_id"], base)  # another project than the other writer's
    with pytest.raises(Conflict):
        one.replace("projects", one.read("projects", "p7"), ["project_id"], base)
    two.write("projects", spark.createDataFrame([], SCHEMAS["projects"]), "p9")
    listed = one.list_projects().collect()
    assert [r["project_id"] for r in listed] == [f"p{i}" for i in range(500) if i != 9] and [r["state"] for r in listed[6:9]] == ["IDLE", "RUNNING", "FAILED"]
    assert [one.project(p).count() for p in ("p7", "p9", "p10", "other")] == [1, 0, 1, 0] and one.read("projects", "p7", "p10").count() == 2
    one.write("projects", rows.limit(3))
    assert two.read("projects").count() == 3 and not two.project("p7").count()


def _log_rows(spark, *pairs):
    shape = "run_id string, project_id string, state string, stage string, counts map<string,bigint>, warnings array<string>, error string, updated_at timestamp"
    return spark.createDataFrame([(r, p, "", "", {}, [], None, None) for r, p in pairs], shape).coalesce(1)


@pytest.mark.parametrize("step", ["_versions", "_entries", "_newest", "_add", "_publish", "_frame"])
@pytest.mark.parametrize("before", [True, False])
def test_store_with_another_writer_within_each_step(spark, tmp_path, step, before):
    """Whatever step of a write another one falls into, both are there afterwards."""
    from terrane.operators.store import Store

    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    one.write("runs", _log_rows(spark, ("0", "a")), "a")
    plain, left = getattr(one, step), ["b", "c"]

    def interleaved(*arguments):
        if before and left:
            other = left.pop()
            two.write("runs", _log_rows(spark, ("2", other)), other)
        out = plain(*arguments)
        if not before and left:
            other = left.pop()
            two.write("runs", _log_rows(spark, ("2", other)), other)
        return out

    setattr(one, step, interleaved)
    one.write("runs", _log_rows(spark, ("1", "a")), "a")
    one.append("runs", _log_rows(spark, ("3", "a")), "a")
    assert sorted((r["run_id"], r["project_id"]) for r in two.read("runs").collect()) == sorted([("1", "a"), ("3", "a")] + [("2", p) for p in "bc" if p not in left])
    assert len(left) < 2, "the step was taken"
    assert not [p for p in (tmp_path / "store/runs/versions").iterdir() if p.name.startswith(".v") and not p.name.endswith(".crc")], "private names are gone"


def test_store_under_eight_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from terrane.operators.store import Store

    def work(k):
        store = Store(spark, str(tmp_path / "store"))
        for turn in range(3):
            store.write("runs", _log_rows(spark, (f"w{turn}", f"own{k}")), f"own{k}")
            store.append("runs", _log_rows(spark, (f"{k}-{turn}", "shared")), "shared")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(work, range(8)))
    got = sorted((r["run_id"], r["project_id"]) for r in Store(spark, str(tmp_path / "store")).read("runs").collect())
    assert got == sorted([("w2", f"own{k}") for k in range(8)] + [(f"{k}-{t}", "shared") for k in range(8) for t in range(3)])


def test_watch(spark, tmp_path):
    from terrane.operators.store import Store
    from terrane.streaming.watch import FILES as SHAPE
    from terrane.streaming.watch import watch

    row = lambda path, h, day: ("p", path, 1, f"2024-01-0{day} 00:00:00", h, "groovy", "plain_groovy", "pending")
    source, store, seen = str(tmp_path / "in"), Store(spark, str(tmp_path / "store")), []
    raw = SHAPE.replace("mtime timestamp", "mtime string")
    for rows in ([row("a", "1", 1), row("b", "1", 1), row("a", "2", 2)], [row("a", "2", 3), row("b", "3", 3)]):
        spark.createDataFrame(rows, raw).withColumn("mtime", F.to_timestamp("mtime")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SHAPE).parquet(source)
        watch(stream, store, str(tmp_path / "check"), lambda new, run: seen.append((run, sorted(r["path"] for r in new.collect())))).awaitTermination()
    assert seen == [("batch-0", ["a", "b"]), ("batch-1", ["b"])]
    assert {r["path"]: (r["content_hash"], r["last_run_id"]) for r in store.read("files").collect()} == {"a": ("2", "batch-0"), "b": ("3", "batch-1")}


def test_vectors_and_chunks(spark):
    vectors = retrieval.hashed_vectors(["loan service", None])
    assert vectors.shape == (2, 384) and abs((vectors**2).sum(1) - 1).max() < 1e-5
    rows = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    assert [r["chunk_id"] for r in retrieval.search(rows, [0.0, 1.0], 2).collect()] == ["a", "c"]


def test_inventory_lists_hidden_empty_and_unreadable_files(spark, tmp_path):
    from terrane.sources import inventory

    root = tmp_path / "project"
    files = {".gitignore": "*.tmp\n", ".ci/build.yml": "a: 1\n", "_x/_y.txt": "under", "empty.txt": "", "a b.java": "class A {}", "node_modules/x/y.js": "no", "z.tmp": "no", "big.txt": "x" * (2 << 20), "build.gradle": "x"}
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    listed = inventory.listing(spark, str(root))
    assert {r["relative"] for r in listed.collect()} == set(files) - {"node_modules/x/y.js"}
    assert inventory.detect_version(spark, str(root), listed) == "3.x"
    patterns = inventory.ignore_patterns(spark, str(root), listed)
    gone = listed.unionByName(listed.filter("relative = 'empty.txt'").withColumns({"path": F.concat("path", F.lit(".gone")), "relative": F.lit("gone.txt")}))
    got = {r["path"]: r for r in inventory.scan(spark, str(root), "3.x", "full", patterns, 1, "p", gone).collect()}
    assert set(got) == {".gitignore", ".ci/build.yml", "_x/_y.txt", "empty.txt", "a b.java", "big.txt", "build.gradle", "gone.txt"}
    status = {p: r["parse_status"] for p, r in got.items()}
    assert status["big.txt"] == "skipped_size" and status["gone.txt"] == "error_read" and status["empty.txt"] == "pending"
    assert got["big.txt"]["content"] is None and got["empty.txt"]["content_hash"] is not None and got["gone.txt"]["content_hash"] is None
    assert column(spark, lambda v: paths.in_scope(v, "files:a,b\0c"), "a,b", "c", "a") == [True, True, False]


def test_groovy_configuration(spark):
    source = "a.b = 'x'\nlist = [1, 2]\nblock {\n  inner { n = 3 }\n  flag = true\n}\n// c = 1\nenvironments {\n  prod { a.b = 'y' }\n}\na.d = \"q\""
    files = spark.createDataFrame([("p", "Config.groovy", source), ("p", "odd", "}}} = {"), ("p", "none", None)], "project_id string, path string, text string")
    got = {r["key"]: (r["value"], r["type"]) for r in configs.groovy_keys(files).filter("path = 'Config.groovy'").collect()}
    assert got == {"a.b": ("x", "str"), "list": ("[1, 2]", "list"), "block.inner.n": ("3", "int"), "block.flag": ("true", "bool"), "a.d": ("q", "str")}
    assert {r["key"]: r["value"] for r in configs.groovy_keys(files, environment="prod").collect()}["a.b"] == "y"
    assert [r["value"] for r in configs.config_symbols(configs.groovy_keys(files)).filter("name = 'n'").select(F.col("properties")["value"].alias("value")).collect()] == ["3"]


def test_database_names_in_their_order(spark):
    rows = [("p", "f", "dataSource.dbcp.url", "A"), ("p", "f", "spring.datasource.url", "B"), ("p", "g", "dataSource.url", "C"), ("p", "g", "dataSource.dbcp.url", "A"), ("p", "h", "jdbc.user", "me")]
    got = {r["path"]: (r["url"], r["username"]) for r in configs.database(spark.createDataFrame(rows, "project_id string, path string, key string, value string")).collect()}
    assert got == {"f": ("A", None), "g": ("C", None), "h": (None, "me")}


def test_xml_that_breaks_off(spark):
    rows = [("p", "ok", "<beans><bean id='a' class='X'/></beans>"), ("p", "cut", "<beans><bean id='b' class='Y'/><bean id="), ("p", "empty", ""), ("p", "null", None)]
    files = spark.createDataFrame(rows, "project_id string, path string, text string")
    got = {r["path"]: (r["root_tag"], len(r["beans"]), r["error"] is None) for r in configs.parse_xml(files).collect()}
    assert got["ok"] == ("beans", 1, True) and got["cut"] == ("beans", 1, False) and got["empty"][:2] == (None, 0) and got["null"][:2] == (None, 0)
    assert {r["path"]: r["found"] for r in configs.xpath_lookup(files, "//bean/@id").collect()} == {"ok": ["a"]}


def test_questions_about_nothing_and_followed_edges(spark):
    symbols = _symbols(spark)
    edges = spark.createDataFrame([("m1", "m2", "", "CALLS", "s", 1, "EXACT"), ("m3", "m1", "", "CALLS", "s", 2, "LIKELY")], EDGES).withColumn("project_id", F.lit("p"))
    for question in ("What calls UserService?", "Trace the flow of UserService"):
        assert retrieval.plan(question, symbols, edges, "p")["nodes"].collect() == []
    assert [r["line"] for r in templates.followed("callers_of", edges, "m1").collect()] == [2]
    with pytest.raises(ValueError, match="no single kind"):
        templates.followed("controller_flow", edges, "m1")


def test_settings(monkeypatch):
    from terrane.settings import Settings

    monkeypatch.setenv("TERRANE_MAX_FILE_SIZE_MB", "7")
    monkeypatch.setenv("TERRANE_ALLOWED_PATHS", "/a:/b")
    got = Settings.from_environment()
    assert got.max_file_size_mb == 7 and got.prefixes == ("/a", "/b") and got.max_traversal_depth == 5


def test_chunks_hold_whole_texts(spark):
    text_ = "0123456789" * 450
    rows = spark.createDataFrame([("v", "p", "gsp_view", "f", 1, " doc ", {"static_text": text_}), ("w", "p", "class", "f", 1, "", {"static_text": "x"})], "id string, project_id string, kind string, file_path string, line_start int, docstring string, properties map<string,string>")
    got = retrieval.chunks(rows).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == ["v_0", "v_1", "v_2", "v_3"] and "".join(r["text"] for r in got[1:]) == text_
