"""Resolution over source of several shapes, and after changes, as queries over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.engine import TYPE_KINDS
from terrane.operators import graph, incremental, resolve, routing
from terrane.plans.bindings import PROJECT
from terrane.plans.extraction import written
from terrane.plans.registry import query, staged, table
from terrane.sources import code, code_graph, scopes

REPOSITORY = "package com.n{k};\npublic class Repo{k} {\n    public void load() { }\n}\nclass Other{k} {\n    void load() { }\n}\n"
# What the class of a supplier says of the receiver, by the supplier's key modulo 6; {n} is its nation.
SHAPES = (
    "package com.u{k};\nimport com.n{n}.Repo{n};\nclass U{k} {\n    @Autowired private Repo{n} repo;\n    void go() {\n        repo.load();\n    }\n}\n",
    "package com.n{n};\nclass U{k} {\n    void go(int a, Repo{n} arg) {\n        arg.load();\n    }\n}\n",
    "package com.u{k};\nimport com.n{n}.*;\nclass U{k} {\n    private Other{n} x;\n    void go() {\n        Repo{n} x = find();\n        if (x != null) {\n            x.load();\n        }\n    }\n}\n",
    "package com.u{k};\nclass U{k} {\n    void go() {\n        var y = new Repo{n}();\n        y.load();\n    }\n}\n",
    "package com.u{k};\nimport com.n{n}.Repo{n};\nclass U{k} {\n    private final Repo{n} repo;\n    void go(Other{n} repo) {\n        this.repo.load();\n    }\n}\n",
    "package com.u{k};\nclass U{k} {\n    private Foreign{n} z;\n    void go() {\n        z.load();\n    }\n}\n",
)


@query(f"""WITH u AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 6 AS shape FROM supplier)
    SELECT concat('{PROJECT}:method:com.', CASE WHEN shape = 1 THEN concat('n', n) ELSE concat('u', k) END, '.U', k, '#go(', CASE shape WHEN 1 THEN concat('int,Repo', n) WHEN 4 THEN concat('Other', n) ELSE '' END, ')') AS source_id,
        CAST(CASE shape WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 5 WHEN 4 THEN 6 ELSE 5 END AS BIGINT) AS line,
        CASE WHEN shape < 5 THEN concat('{PROJECT}:method:com.n', n, '.Repo', n, '#load()') END AS target_id, CASE WHEN shape < 5 THEN 'LIKELY' ELSE 'UNRESOLVED' END AS confidence FROM u""")
def scoped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method that two classes of each nation have, called on fields, parameters and locals (which hide fields), by imports, package and unique name."""
    of_shape = lambda i: F.regexp_extract("path", r"U(\d+)", 1).cast("long") % 6 == i
    users = [written(spark, sf_dir, "supplier", "s_suppkey", text, "src/U{k}.java", "plain_java", "java", n="s_nationkey").filter(of_shape(i)) for i, text in enumerate(SHAPES)]
    files = reduce(DataFrame.unionByName, users).unionByName(written(spark, sf_dir, "nation", "n_nationkey", REPOSITORY, "src/Repo{k}.java", "plain_java", "java"))
    declared = staged(code_graph.described(staged(code.declarations(files))))
    lines = code_graph.body_lines(declared)
    symbols = staged(code_graph.code_symbols(declared).filter(F.col("kind").isin(*TYPE_KINDS, "method")))
    calls = staged(scopes.typed_calls(code_graph.body_edges(lines), declared, lines).filter("type = 'CALLS' and target_hint like 'method:load|%'"))
    return resolve.resolve_calls(calls, symbols, code_graph.imports(symbols)).select("source_id", "line", "target_id", "confidence")


@query("""SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 <> 0 THEN concat('supplier:', l_suppkey) END AS target_id, CASE WHEN l_suppkey % 7 <> 0 THEN 'EXACT' ELSE 'UNRESOLVED' END AS confidence,
    CASE WHEN (l_suppkey % 5 <> 0) <> (l_suppkey % 7 <> 0) THEN 'r2' ELSE 'r1' END AS last_run_id FROM lineitem""")
def reresolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that name suppliers as types, after some suppliers came and others went: only the edges of those are resolved again."""
    s, null = table(spark, sf_dir, "supplier"), F.lit(None).cast("string")
    types = s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.lit("class").alias("kind"), F.concat(F.lit("Supplier"), "s_suppkey").alias("name"), F.concat(F.lit("com.Supplier"), "s_suppkey").alias("fqn"), F.lit("f").alias("file_path"), F.lit(1).cast("long").alias("line_start"), F.create_map().cast("map<string,string>").alias("properties"), "s_suppkey")
    before, after = (types.filter(F.col("s_suppkey") % n != 0).drop("s_suppkey") for n in (5, 7))
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct().select(
        F.concat_ws("#", F.lit("line"), "l_orderkey", "l_linenumber").alias("source_id"), F.lit("USES_TYPE").alias("type"), null.alias("target_id"), F.concat(F.lit("type:com.Supplier"), "l_suppkey").alias("target_hint"),
        F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").cast("long").alias("line"), null.alias("confidence"), F.lit("x").alias("extractor"), F.lit(PROJECT).alias("project_id"),
    ).withColumn("origin", incremental.origin())
    run = lambda edges, symbols, name: resolve.resolve_types(edges, symbols).withColumn("last_run_id", F.lit(name)).drop("warning_code")
    stored = run(raw, before, "r1")
    keys = staged(incremental.symbol_keys(incremental.changed_symbols(before, after)))  # a table's size is known: few keys go to the edges, not edges to the keys
    again = run(incremental.affected(incremental.index_rows(raw), keys), after, "r2")
    merged = incremental.refreshed(stored, again)
    part = lambda i: F.split("source_id", "#")[i]
    return merged.select(part(1).cast("long").alias("l_orderkey"), part(2).cast("int").alias("l_linenumber"), "target_id", "confidence", "last_run_id").distinct()


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS k FROM lineitem),
    t AS (SELECT *, o % 13 <> 0 AS in_old, o % 17 <> 0 AS in_new, CASE WHEN k % 5 <> 0 THEN concat('supplier:', k) END AS old_target,
        CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN concat('supplier:', k + 1) ELSE concat('supplier:', k) END AS new_target FROM l)
    SELECT o, p, k, CASE WHEN NOT in_old THEN CASE WHEN new_target IS NULL THEN 'opened' ELSE 'added' END WHEN NOT in_new THEN CASE WHEN old_target IS NULL THEN 'closed' ELSE 'removed' END
            WHEN new_target IS NULL THEN 'opened' WHEN old_target IS NULL THEN 'closed' ELSE 'moved' END AS change,
        CASE WHEN NOT in_old THEN 'edge_added' WHEN NOT in_new THEN 'edge_removed' WHEN old_target IS NOT NULL AND k % 4 = 0 THEN 'target_removed'
            WHEN new_target IS NOT NULL AND CASE WHEN k % 3 = 0 THEN (k + 1) % 6 = 0 ELSE k % 6 = 0 END THEN 'target_added' ELSE 'ambiguity' END AS cause,
        CASE WHEN in_old THEN old_target END AS old_target, CASE WHEN in_new THEN new_target END AS new_target
    FROM t WHERE (in_old OR in_new) AND (NOT in_old OR NOT in_new OR old_target IS DISTINCT FROM new_target)""")
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that differ between two graphs: opened, closed, moved, added and removed ones, with the cause."""
    k, null = F.col("l_suppkey"), F.lit(None).cast("string")
    supplier = lambda n: F.concat(F.lit("supplier:"), n.cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct().withColumns({"origin": F.concat_ws("#", "l_orderkey", "l_partkey", "l_suppkey"), "type": F.lit("CALLS"), "source_id": F.lit("s"), "file_path": F.lit("f"), "line": F.lit(1).cast("long")})
    old = rows.filter("l_orderkey % 13 <> 0").withColumn("target_id", F.when(k % 5 != 0, supplier(k)).otherwise(null))
    new = rows.filter("l_orderkey % 17 <> 0").withColumn("target_id", F.when(k % 7 == 0, null).when(k % 3 == 0, supplier(k + 1)).otherwise(supplier(k)))
    ids = rows.select(k.alias("n")).unionByName(rows.select((k + 1).alias("n"))).distinct()
    got = graph.compare(old, new, ids.filter("n % 6 <> 0").select(supplier(F.col("n")).alias("id")), ids.filter("n % 4 <> 0").select(supplier(F.col("n")).alias("id")))
    part = lambda i: F.split("origin", "#")[i].cast("long")
    return got.select(part(0).alias("o"), part(1).alias("p"), part(2).alias("k"), "change", "cause", "old_target", "new_target")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN concat('own:', c_nationkey) WHEN 1 THEN concat('own:', c_nationkey) WHEN 2 THEN concat('special:', c_nationkey) WHEN 3 THEN concat('rest:', c_nationkey) WHEN 4 THEN 'any' END AS id FROM customer""")
def routed_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concrete URIs to the most specific of four patterns (three of them for each nation); some fit none."""
    nation, n = table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    made = [("own:", "/n", "/$id?"), ("special:", "/n", "/special/$x"), ("rest:", "/n", "/**")]
    patterns = reduce(DataFrame.unionByName, [nation.select(F.concat(F.lit(i), n).alias("id"), F.concat(F.lit(a), n, F.lit(b)).alias("pattern")) for i, a, b in made])
    patterns = patterns.unionByName(nation.filter("n_nationkey = 0").select(F.lit("any").alias("id"), F.lit("/$controller/$action").alias("pattern")))
    k, at = F.col("c_custkey").cast("string"), F.concat(F.lit("/n"), F.col("c_nationkey").cast("string"))
    how = F.col("c_custkey") % 6
    uri = (
        F.when(how == 0, F.concat(at, F.lit("/"))).when(how == 1, F.concat(at, F.lit("/"), k, F.lit("#top"))).when(how == 2, F.concat(at, F.lit("/special/"), k, F.lit("?page=1/2")))
        .when(how == 3, F.concat(at, F.lit("/a/b/"), k)).when(how == 4, F.concat(F.lit("/x"), k, F.lit("/list"))).otherwise(F.concat(F.lit("/x"), k, F.lit("/list/of/it")))
    )
    asked = table(spark, sf_dir, "customer").select("c_custkey", uri.alias("uri"))
    return asked.join(routing.route(asked, patterns), "uri", "left").select("c_custkey", "id")


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS how FROM part)
    SELECT k, CASE how WHEN 0 THEN concat('page:web-app/v', k, '/part', k, '.jsp') WHEN 1 THEN concat('page:web-app/v', k, '/part', k, '.jsp') WHEN 2 THEN concat('page:web-app/v', k, '/part', k, '.jsp')
        WHEN 3 THEN concat('page:grails-app/views/t', k, '/_row.gsp') WHEN 4 THEN concat('tag:', k) END AS target_id,
        CASE WHEN how = 2 THEN 'LIKELY' WHEN how = 5 THEN 'UNRESOLVED' ELSE 'EXACT' END AS confidence, CASE WHEN how = 5 THEN 'missing_tag' END AS warning_code FROM p""")
def included_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes by relative and absolute paths and by the only file of a name, templates with their underscore, tags of libraries and unknown ones."""
    part, k, null = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.lit(None).cast("string")
    lit = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    symbol = lambda id, kind, path, fqn: part.select(id.alias("id"), F.lit(kind).alias("kind"), fqn.alias("fqn"), path.alias("file_path"))
    page, row = lit("web-app/v", k, "/part", k, ".jsp"), lit("grails-app/views/t", k, "/_row.gsp")
    symbols = symbol(lit("page:", page), "jsp_view", page, page).unionByName(symbol(lit("page:", row), "gsp_template", row, row)).unionByName(symbol(lit("tag:", k), "custom_tag", F.lit("T.groovy"), lit("ns:tag", k)))
    how = F.col("p_partkey") % 6
    said = (
        F.when(how == 0, lit("include:../v", k, "/./part", k, ".jsp?x=1")).when(how == 1, lit("forward:/v", k, "/part", k, ".jsp")).when(how == 2, lit("include:/elsewhere/part", k, ".jsp"))
        .when(how == 3, F.lit("template:row")).when(how == 4, lit("tag:ns:tag", k)).otherwise(lit("tag:other:tag", k))
    )
    edges = part.select("p_partkey", null.alias("target_id"), said.alias("target_hint"), F.when(how == 3, lit("grails-app/views/t", k, "/list.gsp")).otherwise(F.lit("web-app/from/a.jsp")).alias("file_path"), null.alias("confidence"))
    return resolve.resolve_includes(edges, symbols).select(F.col("p_partkey").alias("k"), "target_id", "confidence", "warning_code")


@query("""WITH a AS (SELECT n_nationkey AS n, unnest(['list', 'listAll', 'show']) AS action FROM nation),
    f AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 6 AS how FROM supplier)
    SELECT k, concat('action:', a.n, ':', action) AS target_id, 'LIKELY' AS confidence, NULL AS warning_code FROM f JOIN a ON
        (how = 0 AND f.n = a.n) OR (how = 1 AND f.n = a.n AND action = 'show') OR (how = 2 AND f.n = a.n AND starts_with(action, 'list')) OR (how = 3 AND a.n IN (f.n, (f.n + 1) % 25) AND action IN ('list', 'show'))
    UNION ALL SELECT k, NULL, CASE how WHEN 4 THEN 'HEURISTIC' ELSE 'UNRESOLVED' END, CASE how WHEN 5 THEN 'missing_action' END FROM f WHERE how > 3""")
def applied_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters for a controller, an action, a beginning, alternatives of both, all, and an unknown controller."""
    nation, null, n = table(spark, sf_dir, "nation"), F.lit(None).cast("string"), F.col("n_nationkey").cast("string")
    lit = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    symbols = nation.withColumn("name", F.explode(F.array(*map(F.lit, ("list", "listAll", "show"))))).select(
        lit("action:", n, ":", F.col("name")).alias("id"), F.lit("action").alias("kind"), "name", lit("com.x.N", n, "xController#", F.col("name")).alias("fqn"), F.lit("f").alias("file_path"), F.lit(1).cast("long").alias("line_start"),
    )
    supplier, m, how = table(spark, sf_dir, "supplier"), F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 6
    after = ((F.col("s_nationkey") + 1) % 25).cast("string")
    said = (
        F.when(how == 0, lit("controller:n", m, "x")).when(how == 1, lit("controller:n", m, "x|action:show")).when(how == 2, lit("controller:n", m, "x*|action:list*"))
        .when(how == 3, lit("controller:n", m, "x|n", after, "x|action:list|show")).when(how == 4, F.lit("all")).otherwise(lit("controller:none", m, "|action:show"))
    )
    edges = supplier.select(F.col("s_suppkey").cast("string").alias("source_id"), null.alias("target_id"), said.alias("target_hint"), F.lit("f").alias("file_path"), F.lit(1).alias("line"), F.when(how == 4, "HEURISTIC").otherwise("UNRESOLVED").alias("confidence"))
    return resolve.resolve_applied(edges, symbols).select(F.col("source_id").cast("long").alias("k"), "target_id", "confidence", "warning_code")
