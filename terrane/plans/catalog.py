"""Queries over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import paths, text
from terrane.operators import diff, graph, resolve, retrieval, templates
from terrane.operators.store import latest
from terrane.plans.bindings import PROJECT, edges, oracle_prelude, symbols
from terrane.plans.registry import ORACLE, QUERIES, query, table
from terrane.sources import configs, views

NODE = ["id", "kind", "name"]
KG = oracle_prelude()


def queries() -> dict:
    """Those of this module and of the modules imported at its end."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- inventory: documents now against an earlier snapshot (ids that end in 0 were not there, every seventh differs, some are gone)


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.lit(PROJECT).alias("project_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id", F.sha2("text", 256).alias("content_hash"))
    then = docs.filter("doc_id % 10 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    gone = docs.filter("doc_id % 50 = 1").withColumn("path", F.concat("path", F.lit(".old")))
    return docs, then.unionByName(gone)


DIFF_SQL = f"""
    WITH docs AS (SELECT '{PROJECT}' AS project_id, concat(source, '/', doc_id) AS path, doc_id, sha256(text) AS content_hash FROM documents),
    prev AS (
        SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM docs WHERE doc_id % 10 <> 0
        UNION ALL SELECT concat(path, '.old'), content_hash FROM docs WHERE doc_id % 50 = 1
    ),
    diff AS (
        SELECT coalesce(d.path, p.path) AS path, CASE WHEN d.path IS NULL THEN 'deleted' WHEN p.path IS NULL THEN 'created' WHEN d.content_hash IS NOT DISTINCT FROM p.content_hash THEN 'unchanged' ELSE 'modified' END AS status
        FROM docs d FULL JOIN prev p ON d.path = p.path
    )"""


@query(DIFF_SQL + " SELECT path, status FROM diff")
def hash_gate_diff(spark, sf_dir):
    return diff.snapshot_diff(*_snapshots(spark, sf_dir)).select("path", "status")


@query(DIFF_SQL + " SELECT count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status <> 'deleted') AS total_scanned FROM diff")
def diff_counts(spark, sf_dir):
    return diff.diff_counts(diff.snapshot_diff(*_snapshots(spark, sf_dir)))


@query(DIFF_SQL + " SELECT path, status FROM diff WHERE starts_with(path, 'src1/')")
def scoped_diff(spark, sf_dir):
    return diff.snapshot_diff(*_snapshots(spark, sf_dir), scope="module:src1/").select("path", "status")


# --- classification: a path for each event
PATHS = [
    ".gitignore", "grails-app/controllers/{}Controller.groovy", "grails-app/services/api/{}Service.groovy", "grails-app/domain/{}.groovy", "grails-app/conf/UrlMappings.groovy", "grails-app/views/layouts/{}.gsp", "grails-app/views/user/_{}.gsp",
    "grails-app/views/user/{}.gsp", "web-app/WEB-INF/{}.jspf", "src/java/{}.java", "config/{}.properties", "build/{}.groovy", "grails-app/conf/Config.groovy", "config/{}.yml", "node_modules/{}.js", "lib/{}.jar", "src/main/groovy/{}.groovy", "target/{}.xml", "builder/{}.txt",
]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(p) for p in PATHS])
    path = F.replace(F.element_at(kinds, (F.col("event_id") % len(PATHS) + 1).cast("int")), F.lit("{}"), F.concat(F.col("event_type"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", path.alias("path"), F.when(F.col("user_id") % 3 == 0, "2.x").when(F.col("user_id") % 3 == 1, "3.x").otherwise("unknown").alias("version"))


PATHS_SQL = "paths AS (SELECT event_id, replace([" + ", ".join(f"'{p}'" for p in PATHS) + f"][CAST(event_id % {len(PATHS)} + 1 AS INTEGER)], '{{}}', concat(event_type, user_id)) AS path, CASE user_id % 3 WHEN 0 THEN '2.x' WHEN 1 THEN '3.x' ELSE 'unknown' END AS version FROM events)"


#: The rules that PATHS can meet, written out by hand: common ones first, then those of the version.
CLASSIFY_SQL = """CASE
    WHEN regexp_matches(lower(path), '(^|/)[.]gitignore$') THEN 'gitignore'
    WHEN regexp_matches(lower(path), '^grails-app/controllers/(.*/)?[^/]*controller[.]groovy$') THEN 'grails_controller'
    WHEN regexp_matches(lower(path), '^grails-app/services/(.*/)?[^/]*service[.]groovy$') THEN 'grails_service'
    WHEN regexp_matches(lower(path), '^grails-app/domain/(.*/)?[^/]*[.]groovy$') THEN 'grails_domain'
    WHEN lower(path) = 'grails-app/conf/urlmappings.groovy' THEN 'grails_urlmappings'
    WHEN regexp_matches(lower(path), '^grails-app/views/layouts/(.*/)?[^/]*[.]gsp$') THEN 'gsp_layout'
    WHEN regexp_matches(lower(path), '^grails-app/views/(.*/)?_[^/]*[.]gsp$') THEN 'gsp_template'
    WHEN regexp_matches(lower(path), '^grails-app/views/(.*/)?[^/]*[.]gsp$') THEN 'gsp_view'
    WHEN lower(path) LIKE '%.jspf' THEN 'jsp_include'
    WHEN lower(path) LIKE '%.java' THEN 'plain_java'
    WHEN lower(path) LIKE '%.xml' THEN 'xml_config'
    WHEN lower(path) LIKE '%.properties' THEN 'properties_config'
    WHEN version = '2.x' AND lower(path) = 'grails-app/conf/config.groovy' THEN 'grails_config'
    WHEN version = '3.x' AND lower(path) LIKE '%.yml' THEN 'yaml_config'
    WHEN version IN ('2.x', '3.x') AND lower(path) LIKE '%.groovy' THEN 'plain_groovy'
    ELSE 'unknown' END"""


@query(f"WITH {PATHS_SQL} SELECT event_id, {CLASSIFY_SQL} AS artifact_type FROM paths")
def classify_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("event_id", paths.classify(F.col("path"), F.col("version"))["artifact_type"].alias("artifact_type"))


@query(f"WITH {PATHS_SQL} SELECT artifact_type, count(*) AS files FROM (SELECT {CLASSIFY_SQL} AS artifact_type FROM paths) GROUP BY 1")
def inventory_counts(spark, sf_dir):
    return classify_paths(spark, sf_dir).groupBy("artifact_type").agg(F.count("*").alias("files"))


@query(rf"WITH {PATHS_SQL} SELECT event_id, path FROM paths WHERE NOT (regexp_matches(path, '(^|/)(node_modules|\.idea|\.git)(/|$)') OR regexp_matches(path, '\.(class|jar|war|ear|min\.js|min\.css)$') OR CASE WHEN version = '3.x' THEN regexp_matches(path, '^(build|target|out|\.gradle|dist)/') ELSE regexp_matches(path, '^(target|\.grails|staging|web-app/WEB-INF/classes)/') END OR regexp_matches(path, '(^|/)[^/]*\.jspf(/|$)'))")
def ignore_filter(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    return rows.filter(~paths.ignored(F.col("path"), F.col("version")) & ~paths.ignored_by(F.col("path"), ["# pages", "*.jspf", "*.gsp", "!*.gsp"])).select("event_id", "path")


@query("SELECT doc_id, CASE WHEN n_chars * 1024 > 5 * 1048576 THEN 'skipped_size' ELSE 'pending' END AS parse_status FROM documents")
def size_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.parse_status(F.col("n_chars") * 1024, F.lit(True)).alias("parse_status"))


# --- graph templates


def _template(name: str, sql: str, **arguments):
    def run(spark, sf_dir):
        return templates.run_template(name, symbols(spark, sf_dir), edges(spark, sf_dir), **arguments).select(NODE)

    run.__name__ = name if name != "find_symbol" else "symbol_find"
    query(f"{KG} SELECT id, kind, name FROM symbols WHERE {sql}")(run)


def _ends(at: str, id: str, *types: str) -> str:
    other = "source_id" if at == "target_id" else "target_id"
    return f"id IN (SELECT {other} FROM edges WHERE {at} = '{id}' AND type IN ({', '.join(repr(t) for t in types)})) ORDER BY id"


_template("find_symbol", f"project_id = '{PROJECT}' AND (contains(fqn, '#00000001') OR name = '#00000001') ORDER BY id LIMIT 20", pid=PROJECT, q="#00000001")
_template("callers_of", _ends("target_id", "customer:7", "CALLS") + " LIMIT 50", id="customer:7")
_template("callees_of", _ends("source_id", "order:11", "CALLS") + " LIMIT 50", id="order:11")
_template("file_symbols", f"project_id = '{PROJECT}' AND file_path = 'nation'", pid=PROJECT, fp="nation")
_template("injects", _ends("source_id", "customer:3", "INJECTS"), id="customer:3")
_template("injected_into", _ends("target_id", "nation:2", "INJECTS"), id="nation:2")
_template("declares", _ends("source_id", "region:1", "DECLARES"), id="region:1")
_template("renders_view", _ends("source_id", "order:5", "RENDERS"), id="order:5")
_template("domain_relations", "id IN (SELECT source_id FROM edges WHERE target_id = 'region:1' AND type = 'HAS_RELATION' UNION ALL SELECT target_id FROM edges WHERE source_id = 'region:1' AND type = 'HAS_RELATION')", id="region:1")


@query(f"{KG}, reach AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT CASE WHEN e.type = 'DECLARES' THEN e.target_id ELSE e.source_id END, r.depth + 1 FROM reach r JOIN edges e ON (e.type = 'DECLARES' AND e.source_id = r.id) OR (e.type IN ('INJECTS', 'CALLS') AND e.target_id = r.id) WHERE r.depth < 3) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY id")
def traverse_bounded(spark, sf_dir):
    """From a region down to the orders of its nations' customers."""
    e = edges(spark, sf_dir).filter("type in ('DECLARES', 'INJECTS', 'CALLS')")
    down = e.filter("type = 'DECLARES'").select("source_id", "target_id")
    up = e.filter("type <> 'DECLARES'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return templates.traverse(down.unionByName(up), spark.createDataFrame([("region:0",)], "id string"))


# --- maintenance: customers as the changed symbols


@query(f"{KG}, new AS (SELECT id, concat(name, ' v2') AS name FROM symbols WHERE kind = 'customer' AND line_start % 3 = 0 UNION ALL SELECT concat(id, ':new'), name FROM symbols WHERE kind = 'nation') SELECT id, name, 'r2' AS last_run_id FROM new UNION ALL SELECT id, name, 'r1' FROM symbols WHERE id NOT IN (SELECT id FROM new)")
def node_upsert(spark, sf_dir):
    old = symbols(spark, sf_dir).withColumn("last_run_id", F.lit("r1"))
    changed = old.filter("kind = 'customer' and line_start % 3 = 0").withColumn("name", F.concat("name", F.lit(" v2"))).unionByName(old.filter("kind = 'nation'").withColumn("id", F.concat("id", F.lit(":new"))))
    return graph.upsert_nodes(old, changed, "r2").select("id", "name", "last_run_id")


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).withColumn("last_run_id", F.when(F.col("line_start") % 4 == 0, "r1").otherwise("r2"))


GONE = "gone AS (SELECT id FROM symbols WHERE file_path IN ('customer', 'supplier') AND line_start % 4 = 0)"


@query(f"{KG}, {GONE} SELECT source_id, target_id, type FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def stale_delete(spark, sf_dir):
    files = spark.createDataFrame([("customer",), ("supplier",)], "file_path string")
    return graph.delete_stale(_stamped(spark, sf_dir), edges(spark, sf_dir), files, "r2")[1].select("source_id", "target_id", "type")


@query(f"{KG} SELECT id, kind, name FROM symbols WHERE file_path <> 'part'")
def file_delete(spark, sf_dir):
    return graph.delete_files(symbols(spark, sf_dir), edges(spark, sf_dir), spark.createDataFrame([("part",)], "file_path string"))[0].select(NODE)


@query(f"{KG}, live AS (SELECT id FROM symbols WHERE NOT (kind IN ('customer', 'part') AND line_start % 13 = 0)) SELECT source_id, type, CASE WHEN source_id NOT IN (SELECT id FROM live) THEN 'delete' WHEN target_id NOT IN (SELECT id FROM live) THEN 'downgrade' ELSE 'keep' END AS action, CASE WHEN source_id IN (SELECT id FROM live) AND target_id NOT IN (SELECT id FROM live) THEN NULL ELSE target_id END AS target_id, CASE WHEN source_id IN (SELECT id FROM live) AND target_id NOT IN (SELECT id FROM live) THEN CASE type WHEN 'CALLS' THEN 'ambiguous_call' WHEN 'INJECTS' THEN 'unresolved_di' WHEN 'USES_TYPE' THEN 'missing_symbol' END END AS warning_code FROM edges")
def dangling_sweep(spark, sf_dir):
    live = symbols(spark, sf_dir).filter("not (kind in ('customer', 'part') and line_start % 13 = 0)")
    return graph.dangling_sweep(edges(spark, sf_dir), live).select("source_id", "type", "action", "target_id", "warning_code")


# --- resolution


@query("SELECT o_orderkey, concat('Customer#', o_custkey) AS customer, o_orderpriority AS prio, CASE WHEN o_orderkey % 2 = 0 THEN 'a:b' END AS uri FROM orders")
def hint_map(spark, sf_dir):
    """Hints `customer:...|prio:...|flag|uri:a:b`: a part without a key counts for nothing, values keep later colons."""
    hints = F.concat_ws("|", F.lit("prio:none"), F.concat(F.lit("customer:Customer#"), F.col("o_custkey")), F.concat(F.lit("prio:"), F.col("o_orderpriority")), F.lit("flag"), F.when(F.col("o_orderkey") % 2 == 0, "uri:a:b"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[text.hint(hints, k).alias(k) for k in ("customer", "prio", "uri")])


def _hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each order and supplier: by full name, by simple name, by a part's ambiguous name, or none."""
    kind = F.col("l_orderkey") % 4
    wanted = F.when(kind == 0, F.concat(F.lit("type:supplier."), F.col("s_name"))).when(kind == 1, F.concat(F.lit("type:"), F.col("s_name"))).when(kind == 2, F.concat(F.lit("type:"), F.col("p_name"))).otherwise("other:x")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.concat(F.lit("order:"), "l_orderkey").alias("source_id"), F.lit(None).cast("string").alias("target_id"), wanted.alias("target_hint"), F.lit("USES_TYPE").alias("type"), F.lit("orders").alias("file_path"), F.lit(None).cast("string").alias("confidence"))


HINTED = "hinted AS (SELECT concat('order:', l_orderkey) AS source_id, CASE l_orderkey % 4 WHEN 0 THEN concat('supplier.', s_name) WHEN 1 THEN s_name WHEN 2 THEN p_name END AS wanted FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), byfqn AS (SELECT fqn, arg_max(id, (line_start, id)) AS id FROM symbols GROUP BY fqn), byname AS (SELECT name, min(id) AS id FROM (SELECT split_part(regexp_extract(name, '[^.]*$'), '#', 1) AS name, id FROM symbols) GROUP BY name HAVING count(*) = 1)"


@query(f"{KG}, {HINTED} SELECT source_id, coalesce(f.id, n.id) AS target_id, CASE WHEN f.id IS NOT NULL THEN 'EXACT' WHEN n.id IS NOT NULL THEN 'LIKELY' ELSE 'UNRESOLVED' END AS confidence FROM hinted h LEFT JOIN byfqn f ON h.wanted = f.fqn LEFT JOIN byname n ON h.wanted = n.name")
def resolve_tiers(spark, sf_dir):
    return resolve.resolve_types(_hinted(spark, sf_dir), symbols(spark, sf_dir)).select("source_id", "target_id", "confidence")


@query("""
    WITH e AS (SELECT c_custkey, lower(c_mktsegment) AS controller, concat('n', c_nationkey) AS view FROM customer),
    v AS (SELECT concat('grails-app/views/', CASE WHEN n_nationkey % 2 = 0 THEN 'building/' ELSE '' END, 'n', n_nationkey, '.gsp') AS path, concat('view:', n_nationkey) AS id, concat('n', n_nationkey) AS short FROM nation)
    SELECT c_custkey, coalesce(a.id, b.id, s.id) AS target_id, CASE WHEN coalesce(a.id, b.id) IS NOT NULL THEN 'EXACT' WHEN s.id IS NOT NULL THEN 'LIKELY' ELSE 'UNRESOLVED' END AS confidence
    FROM e LEFT JOIN v a ON a.path = concat('grails-app/views/', controller, '/', view, '.gsp') LEFT JOIN v b ON b.path = concat('grails-app/views/', view, '.gsp') LEFT JOIN v s ON s.short = view
""")
def render_candidates(spark, sf_dir):
    pages = table(spark, sf_dir, "nation").select(F.concat(F.lit("view:"), "n_nationkey").alias("id"), F.concat(F.lit("grails-app/views/"), F.when(F.col("n_nationkey") % 2 == 0, "building/").otherwise(""), F.lit("n"), "n_nationkey", F.lit(".gsp")).alias("file_path"), F.lit("gsp_view").alias("kind"))
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("view:n"), "c_nationkey", F.lit("|controller:"), "c_mktsegment").alias("target_hint"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("confidence"))
    return resolve.resolve_renders(wanted, pages).select("c_custkey", "target_id", "confidence")


# --- configuration and pages


@query("SELECT event_id, concat(CASE WHEN event_id % 5 = 0 THEN 'Api_Token_' ELSE 'value_' END, 'k') AS key, CASE WHEN event_id % 5 = 0 THEN '[REDACTED]' ELSE json_extract_string(props, '$.k') END AS value FROM events")
def flatten_redact_config(spark, sf_dir):
    keys = configs.json_keys(table(spark, sf_dir, "events"), "props", "event_id")
    named = keys.withColumn("key", F.concat(F.when(F.col("event_id") % 5 == 0, "Api_Token_").otherwise("value_"), "key"))
    return named.select("event_id", "key", text.redacted(F.col("key"), F.col("value")).alias("value"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT page_id, CASE WHEN instr(html, '<article>') = 0 THEN 1 ELSE CAST(length(left(html, instr(html, '<article>') - 1)) - length(replace(left(html, instr(html, '<article>') - 1), chr(10), '')) + 1 AS BIGINT) END AS line FROM pages")
def line_number(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.line_of(F.col("html"), F.lit("<article>")).alias("line"))


@query("SELECT doc_id, i AS nth, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS chunk FROM (SELECT doc_id, text, CAST(unnest(generate_series(0, (length(text) - 1) // 2000)) AS INTEGER) AS i FROM documents WHERE text <> '')")
def chunk_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("project_id"), F.lit("gsp_view").alias("kind"), F.lit("f").alias("file_path"), F.lit(1).alias("line_start"), F.lit("").alias("docstring"), F.create_map(F.lit("static_text"), F.col("text")).alias("properties"))
    return retrieval.chunks(rows).select(F.col("symbol_id").cast("long").alias("doc_id"), F.substring_index("chunk_id", "_", -1).cast("int").alias("nth"), F.col("text").alias("chunk"))


# --- retrieval


def _probe() -> list[float]:
    return [((i * 37) % 64 - 31.5) / 256 for i in range(64)]


def _distance_sql(where: str) -> str:
    probe = ", ".join(f"CAST({x} AS DOUBLE)" for x in _probe())
    return f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, [{probe}]), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), 5) AS distance FROM embeddings WHERE {where} ORDER BY 2, 1 LIMIT 10"


@query(_distance_sql("true"))
def vector_topk(spark, sf_dir):
    return retrieval.search(table(spark, sf_dir, "embeddings"), _probe(), 10, id="vec_id").select("vec_id", F.round("distance", 5).alias("distance"))


@query(_distance_sql("label = 3"))
def filtered_topk(spark, sf_dir):
    return retrieval.search(table(spark, sf_dir, "embeddings"), _probe(), 10, F.col("label") == 3, "vec_id").select("vec_id", F.round("distance", 5).alias("distance"))


#: The intents' patterns in their order, written out by hand.
INTENT_SQL = """CASE
    WHEN regexp_matches(lower(q), 'where is|which file|find the|where does|location of|file for') THEN 'Location'
    WHEN regexp_matches(lower(q), 'what calls|who uses|what breaks if|callers of|impact of changing|dependents of') THEN 'Impact'
    WHEN regexp_matches(lower(q), 'trace|follow|from request to|end to end|flow of|request flow|execution path') THEN 'Trace'
    WHEN regexp_matches(lower(q), 'what injects|what renders|what does .* use|depends on|relationship between|connected to') THEN 'Relation'
    WHEN regexp_matches(lower(q), 'list all|show all|what controllers|what services|what domains|how many|enumerate') THEN 'Discovery'
    ELSE 'Logic' END"""
OPENINGS = ["Where is ", "What calls ", "Trace the flow of ", "what does the page use ", "List all ", "How does it ", ""]


@query("WITH t AS (SELECT conv_id, turn, concat([" + ", ".join(f"'{o}'" for o in OPENINGS) + f"][CAST(conv_id % {len(OPENINGS)} + 1 AS INTEGER)], text) AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, {INTENT_SQL} AS intent FROM t")
def route_questions(spark, sf_dir):
    asked = F.concat(F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), (F.col("conv_id") % len(OPENINGS) + 1).cast("int")), F.col("text"))
    return retrieval.routed(table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("text", asked)).select("conv_id", "turn", "intent")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+(?:[A-Z][a-z]+)*')) AS INTEGER) AS symbols, CAST(len(regexp_extract_all(text, '/[A-Za-z0-9_/.-]+/')) AS INTEGER) AS paths FROM documents")
def extract_entities(spark, sf_dir):
    e = text.entities(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(e["symbol_names"]).alias("symbols"), F.size(e["file_paths"]).alias("paths"))


@query(f"{KG}, hit AS (SELECT source_id AS id, 0 AS ord FROM edges WHERE type = 'CALLS' AND target_id = 'customer:7' UNION ALL SELECT source_id, 1 FROM edges WHERE type = 'INJECTS' AND target_id = 'nation:2'), best AS (SELECT id, min(ord) AS ord FROM hit GROUP BY id) SELECT id, kind, CAST(ord AS INTEGER) AS template FROM symbols JOIN best USING (id) ORDER BY ord, id LIMIT 50")
def context_pack(spark, sf_dir):
    s, e = symbols(spark, sf_dir), edges(spark, sf_dir)
    both = templates.run_template("callers_of", s, e, id="customer:7").withColumn("template", F.lit(0)).unionByName(templates.run_template("injected_into", s, e, id="nation:2").withColumn("template", F.lit(1)))
    first = both.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("template"))).filter("nth = 1")
    return first.orderBy("template", "id").limit(retrieval.MOST_NODES).select("id", "kind", "template")


# --- registry


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def run_log_latest(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumn("order", F.struct("ts", "event_id"))
    return latest(log, ["user_id"], "order").select("user_id", "event_id", "event_type")


@query("SELECT user_id, max(ts) AS last_indexed_at FROM events GROUP BY user_id ORDER BY 2 DESC, 1")
def list_projects(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_indexed_at")).orderBy(F.col("last_indexed_at").desc(), "user_id")


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS static_text FROM pages")
def static_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", views.static_text(F.col("html")).alias("static_text"))


# Their queries register themselves.
from terrane.plans import extraction, linking, searching, serving  # noqa: E402, F401
