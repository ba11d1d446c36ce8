"""Resolution passes, graph maintenance, templates, the registry and the engine's calls as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.engine import Engine, verified
from terrane.functions import paths, text
from terrane.operators import graph, resolve, retrieval, templates
from terrane.operators.store import NEXT_STATES, SCHEMAS, Store
from terrane.plans.bindings import PROJECT, edges, oracle_prelude, symbols
from terrane.plans.registry import query, scratch, staged, table
from terrane.sources import code_graph

KG = oracle_prelude()


def _null() -> Column:
    return F.lit(None).cast("string")


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _symbol(rows: DataFrame, id: Column, kind: str, name: Column, fqn: Column, file: Column, line: Column, **properties: Column) -> DataFrame:
    held = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v)]) if properties else F.create_map()
    return rows.select(
        id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), fqn.alias("fqn"), file.alias("file_path"), line.cast("long").alias("line_start"),
        F.lit(PROJECT).alias("project_id"), held.cast("map<string,string>").alias("properties"),
    )


def _hinted(rows: DataFrame, source: Column, hint: Column, kind: str, file: Column, line: Column) -> DataFrame:
    return rows.select(
        source.alias("source_id"), _null().alias("target_id"), hint.alias("target_hint"), F.lit(kind).alias("type"), file.alias("file_path"),
        line.cast("long").alias("line"), _null().alias("confidence"),
    )


def _outcome(resolved: DataFrame) -> DataFrame:
    return resolved.select("source_id", "line", "target_id", "confidence", "warning_code")


# --- resolution


@query("""WITH e AS (SELECT l_orderkey % 6 AS how, l_suppkey AS s, concat('l', l_orderkey) AS source_id, l_linenumber AS line, s_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT source_id, CAST(line AS BIGINT) AS line, CASE WHEN how IN (0, 1, 3) OR how = 2 AND line % 2 = 0 THEN concat('supplier:', s) END AS target_id,
        CASE WHEN how IN (0, 1) OR how = 2 AND line % 2 = 0 THEN 'EXACT' WHEN how = 3 THEN 'LIKELY' ELSE 'UNRESOLVED' END AS confidence,
        CASE WHEN how IN (4, 5) OR how = 2 AND line % 2 = 1 THEN 'unresolved_di' END AS warning_code FROM e""")
def resolve_injected(spark, sf_dir):
    """Qualifier, type by full name, type by the file's imports (even lines' files have them), bean name; unknown qualifiers and types end the search."""
    suppliers = table(spark, sf_dir, "supplier")
    k, name = F.col("s_suppkey"), F.col("s_name")
    known = _symbol(suppliers, _said("supplier:", k), "service", name, _said("com.", name), F.lit("supplier"), k, bean_name=_said("bean", k))
    imported = suppliers.select(F.lit("f0").alias("file_path"), F.col("s_suppkey").cast("int").alias("position"), _said("com.", name).alias("import"))
    rows = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == k)
    hints = [_said("qualifier:bean", k), _said("type:com.", name), _said("type:", name), _said("service:bean", k), _said("qualifier:none|service:bean", k), _said("type:Missing|service:bean", k)]
    hint = F.element_at(F.array(*hints), (F.col("l_orderkey") % 6 + 1).cast("int"))
    wanted = _hinted(rows, _said("l", F.col("l_orderkey")), hint, "INJECTS", _said("f", F.col("l_linenumber") % 2), F.col("l_linenumber"))
    return _outcome(resolve.resolve_injects(wanted, known, imported))


@query("""WITH e AS (SELECT o_orderkey % 5 AS how, c_custkey AS c, c_nationkey AS n, o_orderkey AS line FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT concat('customer:', c) AS source_id, CAST(line AS BIGINT) AS line, CASE WHEN how IN (0, 3) THEN concat('customer:', c) WHEN how IN (1, 2) THEN concat('save:', n) END AS target_id,
        CASE how WHEN 0 THEN 'EXACT' WHEN 1 THEN 'LIKELY' WHEN 2 THEN 'EXACT' WHEN 3 THEN 'HEURISTIC' ELSE 'UNRESOLVED' END AS confidence, CAST(NULL AS VARCHAR) AS warning_code FROM e""")
def resolve_called(spark, sf_dir):
    """Own class, a bean's type, an imported class, a unique name; an ambiguous name of an unknown receiver stays open."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    own = _symbol(customers, _said("customer:", k), "method", _said("m", k), _said("com.Nation", F.col("c_nationkey"), "#m", k, "(X)"), F.lit("src"), k)
    saves = _symbol(nations, _said("save:", n), "method", F.lit("save"), _said("com.Nation", n, "#save()"), F.lit("src"), n)
    beans = _symbol(nations, _said("bean:", n), "bean", _said("nation", n, "Bean"), _said("bean", n), F.lit("src"), n, type=_said("com.Nation", n))
    imported = nations.select(F.lit("src").alias("file_path"), n.cast("int").alias("position"), _said("com.Nation", n).alias("import"))
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == k)
    nation = F.col("c_nationkey")
    hints = [_said("method:m", k, "|receiver:"), _said("method:save|receiver:nation", nation, "Bean"), _said("method:save|receiver:Nation", nation), _said("method:m", k, "|receiver:other"), F.lit("method:save|receiver:other")]
    hint = F.element_at(F.array(*hints), (F.col("o_orderkey") % 5 + 1).cast("int"))
    wanted = _hinted(rows, _said("customer:", k), hint, "CALLS", F.lit("src"), F.col("o_orderkey"))
    return _outcome(resolve.resolve_calls(wanted, own.unionByName(saves).unionByName(beans), imported))


@query("""WITH e AS (SELECT ps.l_orderkey % 3 AS how, l_suppkey AS s, concat('l', l_orderkey) AS source_id, l_linenumber AS line FROM lineitem ps)
    SELECT source_id, CAST(line AS BIGINT) AS line, CASE WHEN how < 2 THEN concat('supplier:', s) END AS target_id, CASE how WHEN 0 THEN 'EXACT' WHEN 1 THEN 'LIKELY' ELSE 'UNRESOLVED' END AS confidence, CAST(NULL AS VARCHAR) AS warning_code FROM e""")
def resolve_instantiated(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    known = _symbol(suppliers, _said("supplier:", k), "class", _said("Supply", k), _said("com.x.Supply", k), F.lit("supplier"), k)
    sort = F.col("l_orderkey") % 3
    hint = F.when(sort == 0, _said("class:com.x.Supply", F.col("l_suppkey"), "|file:a")).when(sort == 1, _said("class:Supply", F.col("l_suppkey"), "|file:a")).otherwise("class:Missing|file:a")
    wanted = _hinted(table(spark, sf_dir, "lineitem"), _said("l", F.col("l_orderkey")), hint, "INSTANTIATES", F.lit("a"), F.col("l_linenumber"))
    return _outcome(resolve.resolve_types(wanted, known, "class", "type"))


def _actions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    actions = _symbol(customers, _said("action:", k), "action", _said("a", k), _said("com.Nation", F.col("c_nationkey"), "Controller#a", k), F.lit("src"), k)
    mappings = nations.select(_said("/n", n).alias("uri"), _said("mapping:", n).alias("id"))
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == k), actions, mappings


@query("""WITH e AS (SELECT o_orderkey % 4 AS how, c_custkey AS c, c_nationkey AS n, o_orderkey AS line FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT 'x' AS source_id, CAST(line AS BIGINT) AS line, CASE WHEN how < 2 THEN concat('action:', c) WHEN how = 2 THEN concat('mapping:', n) END AS target_id,
        CASE WHEN how < 2 THEN 'EXACT' WHEN how = 2 THEN 'LIKELY' ELSE 'UNRESOLVED' END AS confidence, CASE WHEN how = 3 THEN 'unresolved_redirect' END AS warning_code FROM e""")
def resolve_redirected(spark, sf_dir):
    rows, actions, mappings = _actions(spark, sf_dir)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    hints = [_said("action:a", k, "|controller:nation", n), _said("action:a", k, "|source_controller:Nation", n), _said("uri:/n", n), F.lit("action:none|controller:nation1")]
    hint = F.element_at(F.array(*hints), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _outcome(resolve.resolve_redirects(_hinted(rows, F.lit("x"), hint, "REDIRECTS_TO", F.lit("src"), F.col("o_orderkey")), actions, mappings))


@query("""WITH e AS (SELECT o_orderkey % 3 AS how, c_custkey AS c, c_nationkey AS n, o_orderkey AS line FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT 'x' AS source_id, CAST(line AS BIGINT) AS line, CASE how WHEN 2 THEN concat('mapping:', n) ELSE concat('action:', c) END AS target_id, CASE how WHEN 0 THEN 'EXACT' ELSE 'LIKELY' END AS confidence, CAST(NULL AS VARCHAR) AS warning_code FROM e""")
def resolve_linked(spark, sf_dir):
    """Links name their controller, or it is their page's folder; or they name a mapping."""
    rows, actions, mappings = _actions(spark, sf_dir)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    hints = [_said("action:a", k, "|controller:nation", n), _said("action:a", k), _said("mapping:/n", n)]
    hint = F.element_at(F.array(*hints), (F.col("o_orderkey") % 3 + 1).cast("int"))
    wanted = _hinted(rows, F.lit("x"), hint, "LINKS_TO", _said("grails-app/views/nation", n, "/show.gsp"), F.col("o_orderkey"))
    return _outcome(resolve.resolve_redirects(wanted, actions, mappings))


@query("""SELECT concat('c', c_custkey) AS source_id, CAST(c_custkey AS BIGINT) AS line, CASE WHEN c_custkey % 30 < 25 THEN concat('layout:', c_custkey % 30) END AS target_id,
    CASE WHEN c_custkey % 30 < 25 THEN 'EXACT' ELSE 'UNRESOLVED' END AS confidence, CASE WHEN c_custkey % 30 >= 25 THEN 'missing_layout' END AS warning_code FROM customer""")
def resolve_used_layouts(spark, sf_dir):
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    layouts = _symbol(table(spark, sf_dir, "nation"), _said("layout:", n), "gsp_layout", _said("l", n, ".gsp"), F.lit(""), _said("grails-app/views/layouts/l", n, ".gsp"), n)
    wanted = _hinted(table(spark, sf_dir, "customer"), _said("c", k), _said("layout:l", k % 30), "USES_LAYOUT", F.lit("v"), k)
    return _outcome(resolve.resolve_layouts(wanted, layouts))


@query(f"{KG}, n AS (SELECT split_part(regexp_extract(name, '[^.]*$'), '#', 1) AS name, id FROM symbols) SELECT name, min(id) AS id FROM n GROUP BY name HAVING count(*) = 1")
def unique_simple_names(spark, sf_dir):
    return resolve.unique_names(symbols(spark, sf_dir)).select("name", "id")


@query(f"{KG} SELECT fqn, arg_max(id, (line_start, id)) AS id FROM symbols GROUP BY fqn")
def fqn_lookup(spark, sf_dir):
    return resolve.fqn_index(symbols(spark, sf_dir))


# --- graph maintenance


@query(f"""{KG}, old AS (SELECT * FROM edges WHERE type = 'CALLS' AND CAST(substr(source_id, 7) AS BIGINT) % 3 = 0),
    new AS (SELECT * FROM edges WHERE type = 'CALLS' AND CAST(substr(source_id, 7) AS BIGINT) % 2 = 0), live AS (SELECT id FROM symbols WHERE kind = 'order' AND line_start % 5 <> 0),
    kept AS (SELECT source_id, target_id, 'r2' AS last_run_id FROM new WHERE source_id IN (SELECT id FROM live))
    SELECT source_id, target_id, 'UNRESOLVED' AS confidence, last_run_id FROM kept UNION ALL SELECT source_id, target_id, 'EXACT', 'r1' FROM old WHERE source_id NOT IN (SELECT source_id FROM kept)""")
def edge_upsert(spark, sf_dir):
    """New edges need a known source and replace old ones of their key; a confidence that is null is UNRESOLVED."""
    calls = edges(spark, sf_dir).filter("type = 'CALLS'").withColumns({"target_hint": F.lit(""), "line": F.lit(1).cast("long"), "last_run_id": F.lit("r1"), "n": F.substring("source_id", 7, 20).cast("long")})
    old, new = calls.filter("n % 3 = 0").drop("n"), calls.filter("n % 2 = 0").drop("n").withColumn("confidence", _null())
    live = symbols(spark, sf_dir).filter("kind = 'order' and line_start % 5 <> 0")
    empty = new.limit(1).withColumn("source_id", F.lit(""))
    return graph.upsert_edges(old, new.unionByName(empty), live, "r2").select("source_id", "target_id", "confidence", "last_run_id")


@query(f"{KG}, new AS (SELECT id FROM symbols WHERE kind = 'customer' AND line_start % 3 = 0 UNION ALL SELECT concat(id, ':new') FROM symbols WHERE kind = 'nation') SELECT count(*) FILTER (id NOT IN (SELECT id FROM symbols)) AS inserted, count(*) FILTER (id IN (SELECT id FROM symbols)) AS updated FROM new")
def upsert_counts(spark, sf_dir):
    old = symbols(spark, sf_dir)
    return graph.upsert_counts(old, old.filter("kind = 'customer' and line_start % 3 = 0").unionByName(old.filter("kind = 'nation'").withColumn("id", F.concat("id", F.lit(":new")))))


@query(f"{KG}, gone AS (SELECT id FROM symbols WHERE file_path IN ('customer', 'supplier') AND line_start % 4 = 0) SELECT id, kind, name FROM symbols WHERE id NOT IN (SELECT id FROM gone)")
def stale_symbols(spark, sf_dir):
    stamped = symbols(spark, sf_dir).withColumn("last_run_id", F.when(F.col("line_start") % 4 == 0, "r1").otherwise("r2"))
    files = spark.createDataFrame([("customer",), ("supplier",)], "file_path string")
    return graph.delete_stale(stamped, edges(spark, sf_dir), files, "r2")[0].select("id", "kind", "name")


@query(f"{KG} SELECT source_id, target_id, type FROM edges WHERE NOT starts_with(source_id, 'part:') AND NOT starts_with(target_id, 'part:')")
def file_delete_edges(spark, sf_dir):
    return graph.delete_files(symbols(spark, sf_dir), edges(spark, sf_dir), spark.createDataFrame([("part",)], "file_path string"))[1].select("source_id", "target_id", "type")


# --- templates


def _renamed(spark, sf_dir, old: str, new: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("type", F.when(F.col("type") == old, new).otherwise(F.col("type")))


@query(f"{KG} SELECT id, kind, name FROM symbols WHERE id IN (SELECT target_id FROM edges WHERE source_id = 'order:5' AND type = 'USES_TYPE')")
def extends(spark, sf_dir):
    return templates.run_template("extends", symbols(spark, sf_dir), _renamed(spark, sf_dir, "USES_TYPE", "EXTENDS"), id="order:5").select("id", "kind", "name")


@query(f"{KG} SELECT id, kind, name FROM symbols WHERE id IN (SELECT target_id FROM edges WHERE source_id = 'customer:5' AND type = 'INJECTS')")
def implements(spark, sf_dir):
    return templates.run_template("implements", symbols(spark, sf_dir), _renamed(spark, sf_dir, "INJECTS", "IMPLEMENTS"), id="customer:5").select("id", "kind", "name")


@query(f"""{KG}, members AS (SELECT target_id AS id FROM edges WHERE type = 'INJECTS' AND source_id = 'customer:7' UNION ALL SELECT source_id FROM edges WHERE type = 'CALLS' AND target_id = 'customer:7')
    SELECT DISTINCT id, kind, name FROM symbols WHERE id IN (SELECT e.target_id FROM edges e JOIN members m ON e.source_id = m.id WHERE e.type IN ('RENDERS', 'CALLS'))""")
def controller_flow(spark, sf_dir):
    """What a customer's orders render and call, with orders and nation as the customer's declared members."""
    e = edges(spark, sf_dir)
    owned = e.filter("type = 'CALLS'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), *[c for c in e.columns if c not in ("source_id", "target_id")]).withColumn("type", F.lit("DECLARES"))
    held = e.filter("type = 'INJECTS'").withColumn("type", F.lit("DECLARES"))
    return templates.run_template("controller_flow", symbols(spark, sf_dir), e.filter("type <> 'DECLARES'").unionByName(owned).unionByName(held), id="customer:7").select("id", "kind", "name")


def _opened(spark, sf_dir) -> DataFrame:
    number = F.substring_index("source_id", ":", -1).cast("long")
    return edges(spark, sf_dir).withColumns({"confidence": F.when(number % 3 == 0, "UNRESOLVED").otherwise("EXACT"), "last_run_id": F.when(number % 2 == 0, "r2").otherwise("r1")})


OPENED = "opened AS (SELECT *, CAST(split_part(source_id, ':', 2) AS BIGINT) AS n FROM edges)"


@query(f"{KG}, {OPENED} SELECT source_id, target_id FROM opened WHERE type = 'RENDERS' AND n % 3 = 0")
def missing_views(spark, sf_dir):
    return templates.run_template("missing_views", symbols(spark, sf_dir), _opened(spark, sf_dir), pid=PROJECT).select("source_id", "target_id")


@query(f"{KG}, {OPENED} SELECT count(*) FILTER (n % 2 = 0 AND n % 3 = 0) AS new_unresolved_count, count(*) FILTER (n % 2 = 0 AND n % 3 = 0 AND type = 'RENDERS') AS missing_views, count(*) FILTER (n % 2 = 0 AND n % 3 <> 0) AS resolved_count FROM opened")
def verify_change(spark, sf_dir):
    return verified(_opened(spark, sf_dir), "r2")


@query(f"{KG} SELECT source_id, target_id, type, confidence, file_path FROM edges WHERE target_id = 'customer:7' AND type = 'CALLS'")
def edges_of_callers(spark, sf_dir):
    return templates.followed("callers_of", edges(spark, sf_dir), "customer:7").select("source_id", "target_id", "type", "confidence", "file_path")


@query(f"{KG} SELECT source_id, target_id, type, confidence, file_path FROM edges WHERE type = 'HAS_RELATION' AND (target_id = 'region:1' OR source_id = 'region:1')")
def edges_of_relations(spark, sf_dir):
    return templates.followed("domain_relations", edges(spark, sf_dir), "region:1").select("source_id", "target_id", "type", "confidence", "file_path")


# --- functions


KINDS_SQL = """CASE kind WHEN 'grails_controller' THEN 'controller' WHEN 'grails_service' THEN 'service' WHEN 'grails_domain' THEN 'domain' WHEN 'grails_taglib' THEN 'tag_lib' WHEN 'grails_job' THEN 'job' WHEN 'gsp_view' THEN 'gsp_view'
    WHEN 'grails_urlmappings' THEN 'url_mappings' ELSE 'plain_groovy' END"""
SOME_KINDS = ["grails_controller", "grails_service", "grails_domain", "grails_taglib", "grails_job", "gsp_view", "grails_urlmappings", "plain_java", "unknown"]


def _kinds(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(k) for k in SOME_KINDS]), (F.col("event_id") % len(SOME_KINDS) + 1).cast("int")).alias("kind"))


KIND_ROWS = f"WITH e AS (SELECT event_id, {SOME_KINDS!r}[CAST(event_id % {len(SOME_KINDS)} + 1 AS INTEGER)] AS kind FROM events)"


@query(f"{KIND_ROWS} SELECT event_id, {KINDS_SQL} AS symbol_kind FROM e")
def artifact_kinds(spark, sf_dir):
    return _kinds(spark, sf_dir).select("event_id", paths.kind_of(F.col("kind")).alias("symbol_kind"))


@query(f"""{KIND_ROWS} SELECT event_id, CASE kind WHEN 'grails_controller' THEN 'Grails Controller' WHEN 'grails_service' THEN 'Grails Service' WHEN 'grails_domain' THEN 'Grails Domain Class' WHEN 'grails_taglib' THEN 'Grails Tag Library'
    WHEN 'grails_job' THEN 'Grails Quartz Job' WHEN 'grails_urlmappings' THEN 'URL Mappings' END AS description, CASE kind WHEN 'grails_domain' THEN 'GORM' END AS orm FROM e""")
def artifact_metadata(spark, sf_dir):
    said = paths.metadata(F.col("kind"))
    return _kinds(spark, sf_dir).select("event_id", F.try_element_at(said, F.lit("description")).alias("description"), F.try_element_at(said, F.lit("orm")).alias("orm"))


STATES = ["NEW", "IDLE", "RUNNING", "COMPLETED", "PARTIAL", "FAILED"]


@query(f"""WITH e AS (SELECT event_id, {STATES!r}[CAST(event_id % 6 + 1 AS INTEGER)] AS a, {STATES!r}[CAST(user_id % 6 + 1 AS INTEGER)] AS b FROM events)
    SELECT event_id, b = 'RUNNING' AND a <> 'RUNNING' OR a = 'RUNNING' AND b IN ('COMPLETED', 'FAILED', 'PARTIAL') OR a IN ('COMPLETED', 'FAILED') AND b = 'IDLE' AS allowed FROM e""")
def run_states(spark, sf_dir):
    """Which steps between states of a project are allowed."""
    at = lambda c: F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col(c) % 6 + 1).cast("int"))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, nexts in NEXT_STATES.items() for b in nexts])
    return table(spark, sf_dir, "events").select("event_id", F.array_contains(pairs, F.concat_ws(">", at("event_id"), at("user_id"))).alias("allowed"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+(?:[A-Z][a-z]+)*'), ',') AS symbol_names, array_to_string(regexp_extract_all(text, '/[A-Za-z0-9_/.-]+/'), ',') AS file_paths,
    array_to_string(regexp_extract_all(text, '(?i)\b(?:GET|POST|PUT|DELETE|PATCH)\b'), ',') AS http_methods FROM documents""")
def entity_values(spark, sf_dir):
    e = text.entities(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[F.concat_ws(",", e[k]).alias(k) for k in ("symbol_names", "file_paths", "http_methods")])


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' WHEN 2 THEN 'public' ELSE 'package' END AS visibility, concat('c', 'ustomer', c_custkey, 'Service') AS bean FROM customer")
def modifiers_and_beans(spark, sf_dir):
    """Visibility of a bit mask (other bits do not matter; private before protected before public) and bean names."""
    bits = F.element_at(F.array(F.lit(2 + 4 + 8), F.lit(4 + 1), F.lit(1 + 16), F.lit(8)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.visibility(bits).alias("visibility"), text.bean_name(F.concat(F.lit("Customer"), "c_custkey", F.lit("Service"))).alias("bean"))


# --- registry and engine


def _seeded(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose store holds the bindings' graph, a registry of documents and a run."""
    engine = Engine(spark, scratch(spark))
    shaped = lambda rows, name: rows.select(*[rows[f.name] if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], SCHEMAS[name]).schema])
    engine.store.write("symbols", shaped(symbols(spark, sf_dir).withColumn("last_run_id", F.lit("r1")), "symbols"))
    engine.store.write("edges", shaped(_opened(spark, sf_dir), "edges"))
    docs = table(spark, sf_dir, "documents").select(F.lit(PROJECT).alias("project_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("content_hash"))
    engine.store.write("files", shaped(docs, "files"))
    rows = [(PROJECT, "/data", "data", "3.x", "IDLE", 2, "r2"), ("other", "/other", "other", "2.x", "NEW", 2, None)]
    made = spark.createDataFrame(rows, "project_id string, root string, name string, version string, state string, index_version int, last_run_id string")
    engine.store.write("projects", shaped(made, "projects"))
    engine.store.log_run("r2", PROJECT, "RUNNING", "SCANNING")
    engine.store.log_run("r2", PROJECT, "COMPLETED", "FINALIZING", {"created": 3})
    return engine


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their place in an order, from 1: each task takes a range, and counts from where the ranges before it end."""
    ranged = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    begins = ends.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(begins, "_range").withColumn("place", (F.col("_before") + F.col("_nth")).cast("int")).drop("_range", "_nth", "_before")


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))


@query(f"{KG} SELECT '{PROJECT}' AS project, 'IDLE' AS project_state, 'COMPLETED' AS run_state, 'FINALIZING' AS stage, (SELECT count(*) FROM symbols) AS nodes, (SELECT count(*) FROM edges) AS edges")
def engine_status(spark, sf_dir):
    """The run names the project; the last row of the run log counts; nodes and edges are counted."""
    s = _seeded(spark, sf_dir).status(run_id="r2")
    return _row(spark, project=s["project"]["project_id"], project_state=s["project"]["state"], run_state=s["run"]["state"], stage=s["run"]["stage"], nodes=s["graph_stats"]["nodes"], edges=s["graph_stats"]["edges"])


@query("""SELECT concat('p', s_suppkey) AS project_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '3.x' ELSE '2.x' END AS version, CASE WHEN s_suppkey % 3 = 0 THEN 'RUNNING' ELSE 'IDLE' END AS state,
    CAST(row_number() OVER (ORDER BY s_nationkey DESC, concat('p', s_suppkey)) AS INTEGER) AS place FROM supplier""")
def engine_projects(spark, sf_dir):
    """A registry with a project for each supplier, listed by the time of their last run, the latest first."""
    engine, s = Engine(spark, scratch(spark)), table(spark, sf_dir, "supplier")
    rows = s.select(
        F.concat(F.lit("p"), "s_suppkey").alias("project_id"), F.concat(F.lit("/"), "s_suppkey").alias("root"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "3.x").otherwise("2.x").alias("version"),
        F.when(F.col("s_suppkey") % 3 == 0, "RUNNING").otherwise("IDLE").alias("state"), F.lit(3).alias("index_version"), F.timestamp_seconds(F.col("s_nationkey") + 1_700_000_000).alias("last_indexed_at"),
    )
    engine.store.write("projects", rows)
    return _placed(engine.list_projects(), F.col("last_indexed_at").desc(), F.col("project_id")).select("project_id", "name", "version", "state", "place")


@query(f"{KG} SELECT id, kind, name FROM symbols WHERE id IN (SELECT source_id FROM edges WHERE target_id = 'customer:7' AND type = 'CALLS') ORDER BY id LIMIT 50")
def engine_query(spark, sf_dir):
    return _seeded(spark, sf_dir).query(PROJECT, "callers_of", id="customer:7").select("id", "kind", "name")


@query("SELECT concat(source, '/', doc_id) AS path, CASE WHEN starts_with(source, 'src1') THEN '' ELSE sha256(text) END AS content_hash FROM documents")
def engine_invalidate(spark, sf_dir):
    """Hashes in scope are forgotten, others stay."""
    engine = _seeded(spark, sf_dir)
    engine.invalidate(PROJECT, "module:src1")
    return engine.store.files(PROJECT).select("path", "content_hash")


@query(f"{KG}, {OPENED} SELECT count(*) FILTER (n % 2 = 0 AND n % 3 = 0) AS new_unresolved_count, count(*) FILTER (n % 2 = 0 AND n % 3 <> 0) AS resolved_count FROM opened")
def engine_verify(spark, sf_dir):
    got = _seeded(spark, sf_dir).verify_change("r2")
    return _row(spark, new_unresolved_count=got["new_unresolved_count"], resolved_count=got["resolved_count"])


@query(f"""{KG}, reach AS (SELECT 'nation:3' AS id, 0 AS depth UNION SELECT e.source_id, r.depth + 1 FROM reach r JOIN edges e ON e.target_id = r.id WHERE r.depth < 3)
    SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY id""")
def engine_change_plan(spark, sf_dir):
    """What depends on a nation: region, customers and suppliers, then their orders."""
    return _seeded(spark, sf_dir).change_plan(PROJECT, "nation:3").select("id", "depth")


@query(f"""{KG}, hit AS (SELECT id, 0 AS ord FROM (SELECT s.id FROM symbols s WHERE s.id IN (SELECT source_id FROM edges WHERE target_id = 'customer:0' AND type = 'CALLS') ORDER BY s.id LIMIT 50) UNION ALL SELECT 'customer:0', 3)
    SELECT id FROM hit ORDER BY ord, id LIMIT 50""")
def engine_ask(spark, sf_dir):
    """An impact question: the anchor's callers, then what else is reached from it backwards."""
    engine = _seeded(spark, sf_dir)
    found = engine.ask(PROJECT, "What calls Customer?")
    return spark.createDataFrame([(n["id"],) for n in found["nodes"]], "id string")


@query(f"{KG} SELECT 'Impact' AS intent, CAST(0 AS BIGINT) AS nodes, (SELECT count(*) FROM symbols) AS held UNION ALL SELECT 'Trace', 0, (SELECT count(*) FROM symbols)")
def ask_about_nothing(spark, sf_dir):
    """Questions about what is not in the graph find nothing of all that it holds."""
    s, e = symbols(spark, sf_dir), edges(spark, sf_dir)
    packs = [retrieval.plan(q, s, e, PROJECT) for q in ("What calls UserService?", "Trace the flow of UserService")]
    held = F.lit(s.count()).alias("held")
    found = [p["nodes"].agg(F.count("*").alias("nodes")).select(F.lit(p["intent"]).alias("intent"), "nodes", held) for p in packs]
    return found[0].unionByName(found[1])


@query("SELECT concat(source, '/', doc_id) AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE sha256(text) END AS content_hash FROM documents")
def registry_replace(spark, sf_dir):
    """Rows of the registry replaced by key, read again as the newest version."""
    store = _seeded(spark, sf_dir).store
    new = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.lit(PROJECT).alias("project_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    held = store.read("files")
    store.replace("files", new.select(*[F.col(c) if c in new.columns else F.lit("new").alias(c) if c == "content_hash" else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns]), ["project_id", "path"])
    return Store(spark, store.root).files(PROJECT).select("path", "content_hash")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def registry_runs(spark, sf_dir):
    """A run log in the store: the latest row of each run counts."""
    store = Store(spark, scratch(spark))
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.lit(PROJECT).alias("project_id"), F.col("event_type").alias("state"), F.lit("x").alias("stage"), F.lit(None).cast("map<string,bigint>").alias("counts"),
        F.lit(None).cast("array<string>").alias("warnings"), _null().alias("error"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id") / 1000000.0)).alias("updated_at"),
    )
    store.write("runs", log)
    return store.runs().select(F.col("run_id").cast("long").alias("user_id"), "state")


@query()
def embedded_chunks(spark, sf_dir):
    """Chunks of documents with their vectors, of the offline backend."""
    docs = table(spark, sf_dir, "documents").select("doc_id", retrieval.embed(F.col("text")).alias("v"))
    return docs.select("doc_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


@query(f"""SELECT concat('src/N', n_nationkey, '.groovy') AS file_path, '{PROJECT}:plain_groovy:src/N' || n_nationkey || '.groovy' AS id FROM nation""")
def files_without_types(spark, sf_dir):
    """A source file that declares no type is one symbol."""
    from terrane.plans.extraction import _declared, written

    files = written(spark, sf_dir, "nation", "n_nationkey", "def x = {k}\n", "src/N{k}.groovy", "plain_groovy", "groovy")
    return code_graph.bare_files(files, _declared(files)).select("file_path", "id")
