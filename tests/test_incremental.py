"""An index that follows changes equals one made anew, whatever came, went or moved."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from terrane.engine import Engine
from terrane.operators import incremental

MODULES, STEPS = 50, 2


def service(k, name, rng):
    methods = "".join(f"  def run{j}() {{ {rng.choice(['1', 'helper()', f'm{k}bService.run{j}()'])} }}\n" for j in range(3) if rng.random() < 0.7)
    return f"package m{k}\nclass {name} {{\n  def m{k}bService\n{methods}  def helper() {{ 2 }}\n}}\n"


def controller(k, rng):
    calls = "\n".join(f"    m{k}{rng.choice('abc')}Service.run{rng.randrange(3)}()" for _ in range(2))
    after = rng.choice([f"    redirect(controller: 'm{k}Y', action: 'show')", f"    render(view: 'page{rng.randrange(2)}')", f"    redirect(action: 'list')", f"    redirect(uri: '/m{k}/u')", ""])
    return f"package m{k}\nclass M{k}{rng.choice('XY')}Controller {{\n  def m{k}aService\n  def m{k}cService\n  def show() {{\n{calls}\n{after}\n  }}\n  def list() {{ new M{k}Thing() }}\n}}\n"


def changed_files(k, step, rng) -> dict[str, str | None]:
    """Some files of a module, each with its next content or None where it goes."""
    made = {
        **{f"grails-app/services/m{k}/M{k}{x}Service.groovy": lambda x=x: service(k, f"M{k}{x}Service", rng) for x in "ABC"},
        f"grails-app/controllers/m{k}/M{k}XController.groovy": lambda: controller(k, rng),
        f"grails-app/controllers/m{k}/M{k}YController.groovy": lambda: controller(k, rng),
        f"grails-app/domain/m{k}/M{k}Thing.groovy": lambda: f"package m{k}\nclass M{k}Thing {{\n  String name{rng.randrange(2)}\n}}\n",
        f"grails-app/views/m{k}X/page0.gsp": lambda: f"<html><meta name='layout' content='m{k}l{rng.randrange(2)}'/><g:link controller='m{k}X' action='{rng.choice(['show', 'list'])}'>x</g:link><g:render template='row'/></html>",
        f"grails-app/views/m{k}X/_row.gsp": lambda: f"<p><m{k}:badge/></p>",
        f"grails-app/conf/m{k}/M{k}Filters.groovy": lambda: f"class M{k}Filters {{\n  def filters = {{\n    some(controller: 'm{k}{rng.choice('XY')}', action: '{rng.choice(['show', '*'])}') {{\n    }}\n  }}\n}}\n",
        f"grails-app/views/m{k}Y/page1.gsp": lambda: f"<html><meta name='layout' content='m{k}l0'/></html>",
        f"grails-app/views/layouts/m{k}l0.gsp": lambda: "<html><g:layoutBody/></html>",
        f"grails-app/views/layouts/m{k}l1.gsp": lambda: "<html><g:layoutBody/>1</html>",
        f"grails-app/conf/m{k}/UrlMappings.groovy": lambda: f'class M{k}UrlMappings {{\n  static mappings = {{\n    "/m{k}/{rng.choice("uv")}"(controller: "m{k}X", action: "{rng.choice(["show", "list"])}")\n  }}\n}}\n',
        f"grails-app/init/m{k}/BootStrap.groovy": lambda: f"class BootStrap {{\n  def m{k}aService\n  def init = {{ m{k}aService.run0() }}\n}}\n",
    }
    first = step == 0
    return {name: (content() if rng.random() < 0.75 else None) for name, content in made.items() if first or rng.random() < 0.35}


def said(engine, pid):
    """Symbols, edges and chunks of a project, without the run that wrote them."""
    symbols, edges = engine._graph(pid)
    chunks = engine.store.read("chunks", pid)
    return {
        "symbols": sorted(map(str, symbols.drop("last_run_id").withColumn("properties", F.sort_array(F.map_entries("properties"))).collect())),
        "edges": sorted(map(str, edges.drop("last_run_id").collect())),
        "chunks": sorted(map(str, chunks.select("chunk_id", "symbol_id", F.md5("text")).collect())),
    }


def test_fifty_sequences_of_changes_equal_a_full_index(spark, tmp_path):
    """Fifty modules, each with changes of its own, indexed step by step and anew; shared ids and names included."""
    root, rng = tmp_path / "project", random.Random(29)
    follows = Engine(spark, str(tmp_path / "follows"))
    for step in range(STEPS + 1):
        for k in range(MODULES):
            for name, content in changed_files(k, step, rng).items():
                path = root / name
                if content is None:
                    path.unlink(missing_ok=True)
                else:
                    path.parent.mkdir(parents=True, exist_ok=True)
                    path.write_text(content)
        run = follows.index(str(root), version="3.x")
        if step == STEPS:
            anew = Engine(spark, str(tmp_path / f"anew{step}"))
            anew.index(str(root), version="3.x")
            got, want = said(follows, run["project_id"]), said(anew, run["project_id"])
            for what in want:
                assert got[what] == want[what], (step, what, [x for x in got[what] if x not in want[what]][:3], [x for x in want[what] if x not in got[what]][:3])
            assert len({line.split("confidence=")[1].split(",")[0] for line in want["edges"]}) >= 3


def test_only_what_a_change_concerns_is_written_and_read(spark, tmp_path):
    root = tmp_path / "project"
    sources = {"grails-app/services/AService.groovy": "class AService {\n  def bService\n  def go() { bService.run() }\n}\n"}
    sources |= {f"grails-app/services/N{i}Service.groovy": f"class N{i}Service {{\n  def n{i + 1}Service\n  def only{i}() {{ n{i + 1}Service.only{i + 1}() }}\n}}\n" for i in range(30)}
    for name, content in sources.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    engine = Engine(spark, str(tmp_path / "store"))
    first = engine.index(str(root), version="3.x")
    pid = first["project_id"]
    calls = lambda: {r["source_id"].rsplit(":", 1)[1]: (r["confidence"], r["last_run_id"]) for r in engine.store.read("edges", pid).filter("type = 'CALLS'").collect()}
    assert calls()["AService#go"][0] == "UNRESOLVED"
    folders = lambda t: {f for fs in engine.store.manifest(t).values() for f in fs}
    before = {t: folders(t) for t in ("symbols", "edges", "chunks")}
    (root / "grails-app/services/BService.groovy").write_text("class BService {\n  def run() { 1 }\n}\n")
    second = engine.index(str(root), version="3.x")
    assert calls()["AService#go"] == ("LIKELY", second["run_id"])
    assert {run for name, (_, run) in calls().items() if name != "AService#go"} == {first["run_id"]}
    resolved = engine._staged_again("resolved", second["run_id"])
    assert {r["file_path"].rsplit("/", 1)[1] for r in resolved.select("file_path").distinct().collect()} == {"AService.groovy", "BService.groovy"}, "no other edge is resolved again"
    for t in before:
        assert len(before[t] - folders(t)) <= 2, "no more buckets than those of two files"
    (root / "grails-app/services/BService.groovy").unlink()
    third = engine.index(str(root), version="3.x")
    assert calls()["AService#go"] == ("UNRESOLVED", third["run_id"])


def test_a_followed_folder_equals_an_indexed_one(spark, tmp_path):
    """New, changed and deleted files show in a stream of listings; a listing without a change, or a replay, writes nothing."""
    from terrane.streaming.watch import follow

    root = tmp_path / "project"
    files = {"grails-app/services/AService.groovy": "class AService {\n  def bService\n  def go() { bService.run() }\n}\n", "grails-app/services/BService.groovy": "class BService {\n  def run() { 1 }\n}\n", "grails-app/views/a/x.gsp": "<p/>"}
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    engine = Engine(spark, str(tmp_path / "store"))
    turn = lambda checkpoint="check": follow(engine, str(root), str(tmp_path / checkpoint), version="3.x").awaitTermination()
    turn()
    (root / "grails-app/services/BService.groovy").unlink()
    (root / "grails-app/views/a/y.gsp").write_text("<html><g:link controller='a' action='x'>x</g:link></html>")
    turn()
    pid = engine.list_projects().first()["project_id"]
    anew = Engine(spark, str(tmp_path / "anew"))
    anew.index(str(root), version="3.x")
    assert said(engine, pid) == said(anew, pid)
    versions = lambda: {t: engine.store.version(t) for t in ("symbols", "edges", "chunks", "files", "runs", "projects")}
    before = versions()
    turn()
    turn("another-checkpoint")  # the same listing again, as in a replay
    assert versions() == before
    runs = [r["run_id"] for r in engine.store.runs().orderBy("updated_at").collect()]
    assert len(runs) == 2
    issues = {(r["type"], r["change"], r["cause"]) for r in engine.verify_change(runs[1])["issues"].collect()}
    assert ("CALLS", "opened", "target_removed") in issues and ("LINKS_TO", "opened", "edge_added") in issues
    assert {r["change"] for r in engine.compare_runs(None, runs[0]).collect()} <= {"added", "opened"} and engine.compare_runs(runs[1], runs[1]).count() == 0


def test_keys(spark):
    shape = "source_id string, type string, target_id string, target_hint string, file_path string, line long, confidence string, extractor string, project_id string"
    edges = spark.createDataFrame([("s", "CALLS", None, "method:run|receiver:bService", "f", 1, None, "x", "p"), ("t", "RENDERS", None, "view:shared/_form|controller:User", "f", 2, None, "x", "p"), ("u", "DECLARES", "v", None, "f", 3, "EXACT", "x", "p"), ("w", "USES_TYPE", None, "type:com.x.A", "f", 4, None, "x", "p")], shape)
    got = {r["source_id"]: set(r["k"]) for r in edges.select("source_id", incremental.edge_keys().alias("k")).collect()}
    assert got == {"s": {"id:s", "name:run", "name:bService", "bean:bService"}, "t": {"id:t", "view:form", "view:_form"}, "u": {"id:u", "id:v"}, "w": {"id:w", "name:A"}}
    symbols = spark.createDataFrame([("m", "method", "run", "com.x.B#run(int)", "B.groovy", {}), ("g", "gsp_layout", "main", "x", "grails-app/views/layouts/main.gsp", {}), ("b", "service", "BService", "com.x.BService", "B.groovy", {"bean_name": "bService"}), ("q", "url_mapping", "/a", "/a", "U.groovy", {})], "id string, kind string, name string, fqn string, file_path string, properties map<string,string>")
    assert {r["key"] for r in incremental.symbol_keys(symbols).collect()} >= {"id:m", "name:run", "layout:main", "view:main", "bean:bService", "name:BService", "uri:/a"}
    rows = incremental.index_rows(edges)
    assert {(r["source_id"]) for r in incremental.affected(rows, spark.createDataFrame([("bean:bService",), ("name:run",), ("id:v",)], "key string")).collect()} == {"s", "u"}
    assert rows.select("origin").distinct().count() == 4


def test_refreshed_deals_edges_out_by_origin_once(spark, tmp_path):
    """Each side was shuffled by origin twice and more, and what made `again` ran twice: disk at 6 GB. Origins of several edges, none, or only new ones."""
    shape = "origin string, target_id string, confidence string, last_run_id string"
    said = lambda name, *rows: (spark.createDataFrame(list(rows), shape).write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    held = said("held", ("a", "t", "EXACT", "r1"), ("b", "t", "EXACT", "r1"), ("c", None, "UNRESOLVED", "r1"), ("d", "u", "LIKELY", "r1"), ("d", "v", "LIKELY", "r1"), (None, "x", "EXACT", "r1"))
    again = said("again", ("b", "t", "EXACT", "r2"), ("c", None, "UNRESOLVED", "r2"), ("d", "w", "LIKELY", "r2"), ("d", "y", "LIKELY", "r2"), ("e", "z", None, "r2"), (None, "x", "EXACT", "r2"))
    out = incremental.refreshed(held, again)
    want = {("a", "t", "EXACT", "r1"), ("b", "t", "EXACT", "r1"), ("c", None, "UNRESOLVED", "r1"), ("d", "w", "LIKELY", "r2"), ("d", "y", "LIKELY", "r2"), ("e", "z", None, "r2"), (None, "x", "EXACT", "r1"), (None, "x", "EXACT", "r2")}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan parquet") == 2
