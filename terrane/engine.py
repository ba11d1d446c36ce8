"""The engine: index, rebuild, query, ask, ask_many, status, list_projects, invalidate, verify_change, change_plan and impact."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.paths import in_scope
from terrane.operators import graph, incremental, resolve, retrieval, templates
from terrane.operators.diff import changed, diff_counts, snapshot_diff
from terrane.operators.reach import reach
from terrane.operators.store import Store, new_run_id
from terrane.operators.vector_index import VectorIndex
from terrane.settings import Settings
from terrane.sources import code, code_graph, configs, inventory, scopes, views

INDEX_VERSION = 4
SYMBOL = ["id", "kind", "name", "fqn", "file_path", "line_start", "line_end", "language", "project_id", "docstring", "source_hash", "properties"]

# Kinds of symbols that are types; edges whose hints name a type, and the keys that name it.
TYPE_KINDS = ["class", "interface", "enum", "controller", "service", "domain", "tag_lib", "job", "interceptor", "bootstrap"]
TYPE_EDGES, TYPE_KEYS = ("EXTENDS", "IMPLEMENTS", "INSTANTIATES", "PROVIDES", "USES_TYPE", "QUERIES_DOMAIN", "HAS_RELATION", "BINDS_COMMAND"), ("class", "interface", "type", "domain", "command")


def extract(files: DataFrame, staged: Callable[[str, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of changed files (path, artifact_type, text ...). `staged` makes a table of declarations, so that source is scanned once."""
    of = lambda *kinds: files.filter(F.col("artifact_type").isin(*kinds))
    gsp = views.parse_gsp(of("gsp_view", "gsp_layout", "gsp_template"))
    jsp = views.parse_jsp(of("jsp_view", "jsp_include"))
    scripts = of("grails_config", "grails_datasource").filter("language = 'groovy'")
    keys = configs.properties(of("properties_config")).select("project_id", "path", "key", "value").withColumn("type", F.lit("str"))
    keys = keys.unionByName(configs.yaml_keys(files.filter("language = 'yaml'"))).unionByName(configs.groovy_keys(scripts))
    beans = staged("beans", configs.xml_beans(configs.parse_xml(of("xml_config"))))
    source = files.filter(F.col("language").isin("groovy", "java"))
    declared = staged("declarations", code_graph.described(staged("scanned", code.declarations(source))))
    lines = code_graph.body_lines(declared)
    (uses, use_edges), (settings, setting_edges) = code_graph.used(lines, declared, by_file=True), code_graph.configured(source, declared, by_file=True)
    found = [
        views.view_symbols(gsp, F.col("artifact_type"), "gsp"), views.view_symbols(jsp, F.col("artifact_type"), "jsp"), configs.config_symbols(keys),
        code_graph.code_symbols(declared, by_file=True), uses, settings, code_graph.bare_files(source, declared), configs.bean_symbols(beans),
    ]
    edges = [views.gsp_edges(gsp), views.jsp_edges(jsp), code_graph.declared_edges(declared), scopes.typed_calls(code_graph.body_edges(lines), declared, lines), use_edges, setting_edges, configs.bean_edges(beans)]
    return reduce(DataFrame.unionByName, [f.select(SYMBOL) for f in found]), reduce(DataFrame.unionByName, edges)


def verified(edges: DataFrame, run_id: str) -> DataFrame:
    """One row: edges of a run that are open (new_unresolved_count), those of them that render (missing_views), and those that are resolved (resolved_count)."""
    own, open_ = F.col("last_run_id") == run_id, F.col("confidence") == "UNRESOLVED"
    return edges.agg(F.count_if(own & open_).alias("new_unresolved_count"), F.count_if(own & open_ & (F.col("type") == "RENDERS")).alias("missing_views"), F.count_if(own & ~open_).alias("resolved_count"))


def visible(symbols: DataFrame) -> DataFrame:
    """Symbols without those that a symbol of the same id in another file stands before."""
    return symbols.filter(~F.coalesce("shadowed", F.lit(False)))


class Engine:
    @classmethod
    def configured(cls, spark: SparkSession, settings: Settings) -> Engine:
        return cls(spark, settings.store_root, settings.prefixes, settings.max_file_size_mb)

    def __init__(self, spark: SparkSession, root: str, allow: tuple[str, ...] = (), most_mb: int = 5) -> None:
        self.spark, self.store, self.allow, self.most_mb = spark, Store(spark, root), list(allow), most_mb

    def index(self, path: str, scope: str = "full", dry_run: bool = False, force: bool = False, version: str | None = None, listed: DataFrame | None = None) -> dict:
        """Scan, diff, extract, resolve and merge. A dry run writes nothing.

        listed: a listing of the folder. If it has the paths, sizes and times of the registry, the run ends there.
        """
        began = time.time()
        if not inventory.allowed(path, self.allow):
            raise ValueError(f"{path} is not in an allowed folder")
        run_id, pid = new_run_id(), inventory.project_id(path)
        stage = (lambda name, df: df) if dry_run else (lambda name, df: self._staged(name, df, run_id))
        follows = listed is not None
        listed = stage("listing", listed if follows else inventory.listing(self.spark, path))
        if follows and not self._moved(listed, pid):
            return {"run_id": run_id, "project_id": pid, "state": "UNCHANGED", "duration_ms": int((time.time() - began) * 1000)}
        version = version or inventory.detect_version(self.spark, path, listed)
        known = self.store.project(pid).first()
        force = force or bool(known and known["index_version"] < INDEX_VERSION)
        patterns = inventory.ignore_patterns(self.spark, path, listed)
        # Contents are read once: what is hashed is what is indexed.
        files = stage("files", inventory.scan(self.spark, path, version, scope, patterns, self.most_mb, pid, listed))
        diff = snapshot_diff(files, self.store.files(pid), scope, force)
        counts = diff_counts(diff).first().asDict()
        by_type = {r["artifact_type"]: r["count"] for r in files.groupBy("artifact_type").count().collect()}
        out = {"run_id": run_id, "project_id": pid, "version": version, "file_counts": by_type, **counts}
        if not dry_run:
            if known is None:
                row = self.spark.createDataFrame([(pid, path, path.rstrip("/").rsplit("/", 1)[-1], version, "NEW", INDEX_VERSION, run_id)], "project_id string, root string, name string, version string, state string, index_version int, last_run_id string")
                self.store.replace("projects", row.withColumn("last_indexed_at", F.lit(None).cast("timestamp")), ["project_id"])
            self.store.set_state(pid, "RUNNING")
            self.store.log_run(run_id, pid, "RUNNING", "SCANNING")
            try:
                self._merge(files, diff, pid, run_id, scope)
                self.store.write("listed", listed.select(F.lit(pid).alias("project_id"), F.col("relative").alias("path"), "size", "mtime"), pid)
            except Exception as error:
                self.store.set_state(pid, "FAILED")
                self.store.log_run(run_id, pid, "FAILED", "FAILED", error=str(error)[:2000])
                raise
            self.store.set_state(pid, "COMPLETED", last_indexed_at=F.current_timestamp(), last_run_id=F.lit(run_id), index_version=F.lit(INDEX_VERSION))
            versions = {f"{t}_version": self.store.version(t) for t in ("symbols", "edges")}
            self.store.log_run(run_id, pid, "COMPLETED", "FINALIZING", counts | versions, self._warnings(run_id, files))
        return out | {"state": "DRY_RUN" if dry_run else "COMPLETED", "duration_ms": int((time.time() - began) * 1000)}

    def _moved(self, listed: DataFrame, pid: str) -> bool:
        """Whether a listing differs from the last one that was indexed, by paths, sizes or times."""
        said = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("path", "size", "mtime")), F.lit(0)).alias("x")).first()
        return said(self.store.read("listed", pid)) != said(listed.select(F.col("relative").alias("path"), "size", "mtime"))

    def _merge(self, files: DataFrame, diff: DataFrame, pid: str, run_id: str, scope: str) -> None:
        """Extracts the touched files, and resolves their edges and those of other files that the changed symbols concern.

        Each table is written in the buckets of these files only. Symbols are written after what is derived from their change,
        and the registry last, so that a run that ends early is made good by the next one.
        """
        key, staged, read = ["project_id", "path"], lambda name, df: self._staged(name, df, run_id), lambda name, **b: self.store.read(name, pid, **b)
        touched = staged("touched", changed(diff).select(*key))
        gone = diff.filter("status = 'deleted'").select(*key)
        text = files.join(touched, key, "left_semi").withColumn("text", F.col("content").cast("string")).drop("content")
        symbols, edges = (staged(name, df) for name, df in zip(("symbols", "edges"), extract(staged("text", text), staged), strict=True))
        paths = staged("paths", touched.unionByName(gone).select(F.col("path").alias("file_path"), "project_id").distinct())
        own = ["file_path", "project_id"]

        held = read("symbols")
        before = read("symbols", buckets=self.store.buckets("symbols", paths)).join(paths, own, "left_semi").select(held.columns)
        after = symbols.withColumns({"last_run_id": F.lit(run_id), "shadowed": F.lit(False)}).select(held.columns)
        ids = before.select("id").unionByName(after.select("id")).distinct()
        elsewhere = staged("elsewhere", held.join(ids, "id", "left_semi").join(paths, own, "left_anti").select(held.columns))  # the same ids in other files
        versions = staged("versions", graph.with_shadows(after.unionByName(elsewhere)).select(held.columns))
        concerned = paths.unionByName(elsewhere.select(own)).distinct()
        all_symbols = visible(staged("all_symbols", held.join(versions.select("id", "file_path"), ["id", "file_path"], "left_anti").join(paths, own, "left_anti").select(held.columns).unionByName(versions)))

        fresh = edges.withColumn("last_run_id", F.lit(run_id)).withColumn("origin", incremental.origin()).dropDuplicates(["origin"])
        keys = staged("keys", incremental.symbol_keys(incremental.changed_symbols(visible(before.unionByName(elsewhere)), visible(versions))))
        index = read("asked", buckets=self.store.buckets("asked", keys)).join(keys, "key", "left_semi").join(read("extracted"), [*own, "last_run_id"], "left_semi")
        again = incremental.affected(index, keys).join(paths, own, "left_anti").withColumn("last_run_id", F.lit(run_id))
        old = read("edges")
        resolved = staged("resolved", self._resolved(fresh.select(old.columns).unionByName(again.select(old.columns)), all_symbols))
        swept = graph.dangling_sweep(graph.upsert_edges(old.filter("false"), resolved.drop("warning_code"), all_symbols, run_id).select(old.columns), all_symbols).filter("action <> 'delete'").select(old.columns)
        in_buckets = self.store.buckets("edges", paths.select("file_path").unionByName(resolved.select("file_path")))
        # An edge that no longer has a symbol at its source goes too: it is in `resolved`, not in `swept`.
        rest = read("edges", buckets=in_buckets).join(paths, own, "left_anti")
        same = incremental.refreshed(rest.join(resolved.select("origin"), "origin", "left_semi").select(old.columns), swept)
        self.store.write("edges", staged("merged_edges", rest.join(resolved.select("origin"), "origin", "left_anti").select(old.columns).unionByName(same)), pid, buckets=in_buckets)

        # Only chunks of symbols that may have changed are embedded; those of deleted files go.
        # Chunks of bodies depend on their file alone, so they are held for shadowed symbols too; see `_chunks`.
        bodies = retrieval.body_chunks(after, self._staged_again("text", run_id))
        chunk = retrieval.chunks(all_symbols.join(concerned, own, "left_semi")).unionByName(bodies, allowMissingColumns=True).withColumn("embedding", retrieval.embed(F.col("text")))
        in_buckets = self.store.buckets("chunks", concerned)
        stored = read("chunks", buckets=in_buckets)
        others = stored.filter("chunk_type <> 'body'").join(concerned, own, "left_anti").select(stored.columns)
        others = others.unionByName(stored.filter("chunk_type = 'body'").join(paths, own, "left_anti").select(stored.columns))
        self.store.write("chunks", others.unionByName(chunk.select(stored.columns)), pid, buckets=in_buckets)
        # The index of what edges ask for is appended to: `extracted` tells which run's rows of a file count.
        rows = incremental.index_rows(edges).withColumn("last_run_id", F.lit(run_id))
        if read("extracted").join(paths, own, "left_anti").isEmpty():
            self.store.write("asked", rows, pid)
        else:
            self.store.append("asked", rows, pid)
        in_buckets = self.store.buckets("extracted", paths)
        marks = read("extracted", buckets=in_buckets).join(paths, own, "left_anti").unionByName(touched.select(F.col("path").alias("file_path"), F.lit(run_id).alias("last_run_id"), "project_id"), allowMissingColumns=True)
        self.store.write("extracted", marks, pid, buckets=in_buckets)
        in_buckets = self.store.buckets("symbols", concerned)
        kept = read("symbols", buckets=in_buckets).join(paths, own, "left_anti").join(versions.select("id", "file_path"), ["id", "file_path"], "left_anti").select(held.columns)
        self.store.write("symbols", kept.unionByName(versions), pid, buckets=in_buckets)
        registry = read("files")
        fresh = files.drop("content").withColumn("last_run_id", F.lit(run_id)).select(registry.columns)
        self.store.write("files", registry.filter(~in_scope(F.col("path"), scope)).unionByName(fresh), pid)

    def _warnings(self, run_id: str, files: DataFrame) -> list[str]:
        """Counts of what a run left open, as code:count; files that were not read by their status."""
        left = self._staged_again("resolved", run_id).filter("warning_code is not null").groupBy(F.col("warning_code").alias("code")).count()
        skipped = files.filter("parse_status <> 'pending'").groupBy(F.col("parse_status").alias("code")).count()
        return sorted(f"{r['code']}:{r['count']}" for r in left.unionByName(skipped).collect())

    def _staged_again(self, name: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.root}/staging/{run_id}/{name}")

    def _staged(self, name: str, df: DataFrame, run_id: str) -> DataFrame:
        """A table of this run only, in the store's folder: what several later writes read is computed once."""
        path = f"{self.store.root}/staging/{run_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _resolved(self, edges: DataFrame, symbols: DataFrame) -> DataFrame:
        mappings = symbols.filter("kind = 'url_mapping'").select(F.col("name").alias("uri"), F.col("fqn").alias("pattern"), "id")
        imports = code_graph.imports(symbols)
        types = symbols.filter(F.col("kind").isin(TYPE_KINDS))
        passes = [
            (("CALLS",), lambda e: resolve.resolve_calls(e, symbols.filter(F.col("kind").isin(*TYPE_KINDS, "method", "action", "bean")), imports)),
            (("INJECTS",), lambda e: resolve.resolve_injects(e, types.unionByName(symbols.filter("kind = 'bean'")), imports)),
            (TYPE_EDGES, lambda e: resolve.resolve_types(e, types, *TYPE_KEYS)),
            (("USES_LAYOUT",), lambda e: resolve.resolve_layouts(e, symbols)),
            (("RENDERS",), lambda e: resolve.resolve_renders(e, symbols)),
            (("INCLUDES_TEMPLATE", "JSP_INCLUDES", "JSP_FORWARDS", "USES_TAG"), lambda e: resolve.resolve_includes(e, symbols)),
            (("APPLIES_TO",), lambda e: resolve.resolve_applied(e, symbols)),
            (("REDIRECTS_TO", "FORWARDS_TO", "CHAINS_TO", "LINKS_TO", "MAPS_TO"), lambda e: resolve.resolve_redirects(e, symbols, mappings)),
        ]
        none = F.lit(None).cast("string").alias("warning_code")
        out = edges.filter(~F.col("type").isin(*[k for kinds, _ in passes for k in kinds])).select("*", none)
        for kinds, resolver in passes:
            out = out.unionByName(resolver(edges.filter(F.col("type").isin(*kinds))).select(*edges.columns, "warning_code"))
        return out

    def _chunks(self, project_id: str) -> DataFrame:
        """Chunks of a project without those of shadowed symbols."""
        hidden = self.store.read("symbols", project_id).filter("shadowed").select(F.col("id").alias("symbol_id"), "file_path")
        chunks = self.store.read("chunks", project_id)
        return chunks.join(hidden, ["symbol_id", "file_path"], "left_anti").select(chunks.columns)

    def _graph(self, project_id: str) -> tuple[DataFrame, DataFrame]:
        """Symbols and edges of a project."""
        return visible(self.store.read("symbols", project_id)), self.store.read("edges", project_id)

    def rebuild(self, project_id: str, scope: str = "incremental") -> dict:
        """scope as for index, or git:RANGE."""
        root = self.store.project(project_id).first()["root"]
        return self.index(root, inventory.git_scope(root, scope[4:]) if scope.startswith("git:") else scope, force=scope == "full")

    def query(self, project_id: str, template: str, **arguments) -> DataFrame:
        symbols, edges = self._graph(project_id)
        return templates.run_template(template, symbols, edges, **({"pid": project_id} if template in ("find_symbol", "file_symbols", "missing_views") else {}), **arguments)

    def query_edges(self, project_id: str, template: str, id: str) -> DataFrame:
        """The edges that a template follows from a symbol, with type, confidence, file and line."""
        return templates.followed(template, self.store.read("edges", project_id), id)

    def settings(self, project_id: str) -> tuple[DataFrame, DataFrame]:
        """Spring profiles and database settings (secrets redacted) of a project's configuration files."""
        keys = self._graph(project_id)[0].filter("kind = 'config_key'")
        keys = keys.select("project_id", F.col("file_path").alias("path"), F.col("fqn").alias("key"), F.try_element_at("properties", F.lit("value")).alias("value"))
        return configs.profiles(keys), configs.database(keys)

    def ask(self, project_id: str, question: str, max_depth: int = 3) -> dict:
        symbols, edges = self._graph(project_id)
        pack = retrieval.plan(question, symbols, edges, project_id, self._chunks(project_id), max_depth)
        nodes, near, texts = (pack[k].collect() for k in ("nodes", "edges", "chunks"))  # each bounded by the pack's caps
        answer = f"{pack['intent']}: {len(nodes)} symbols, {len(near)} relations, {len(texts)} texts. " + ", ".join(f"{n['kind']}:{n['name']}" for n in nodes[:10]) + ". " + ", ".join(sorted({e["type"] for e in near})[:10])
        return {"answer": answer, "intent": pack["intent"], "templates": pack["templates"], "nodes": [n.asDict() for n in nodes], "edges": [e.asDict() for e in near], "chunks": [{**c.asDict(), "text": c["text"][:200]} for c in texts]}

    def status(self, run_id: str | None = None, project_id: str | None = None) -> dict:
        run = self.store.runs().filter(F.col("run_id") == run_id).first() if run_id else None
        pid = run["project_id"] if run else project_id
        project = self.store.project(pid).first()
        symbols, edges = self._graph(pid)
        return {"project": project and project.asDict(), "run": run and run.asDict(), "graph_stats": {"nodes": symbols.count(), "edges": edges.count()}}

    def list_projects(self) -> DataFrame:
        return self.store.list_projects().select("project_id", "name", "root", "version", "state", "last_indexed_at")

    def invalidate(self, project_id: str, scope: str = "full") -> dict:
        """Forgets the hashes in scope, so that the next index sees those files as modified."""
        files, inside = self.store.files(project_id), in_scope(F.col("path"), scope)
        count = files.filter(inside).count()
        self.store.write("files", files.withColumn("content_hash", F.when(inside, F.lit("")).otherwise(F.col("content_hash"))), project_id)
        return {"invalidated_files": count, "next_index_mode": "full" if scope == "full" else "incremental"}

    def verify_change(self, run_id: str) -> dict:
        """Counts of a run's edges, and `issues`: what the run opened, closed or moved, as rows."""
        runs = self.store.runs()
        run = runs.filter(F.col("run_id") == run_id).first()
        pid, before = run["project_id"], runs.filter((F.col("project_id") == run["project_id"]) & (F.col("updated_at") < F.lit(run["updated_at"])) & (F.col("state") == "COMPLETED"))
        last = before.orderBy(F.col("updated_at").desc()).select("run_id").first()
        issues = self.compare_runs(last["run_id"] if last else None, run_id) if "edges_version" in (run["counts"] or {}) else None
        return {"run_id": run_id, "issues": issues} | verified(self.store.read("edges", pid), run_id).first().asDict()

    def compare_runs(self, before: str | None, after: str) -> DataFrame:
        """The edges that differ between the graphs that two runs of a project left (None: an empty one), see graph.compare; as long as their versions are kept."""
        found = {r["run_id"]: r for r in self.store.runs().filter(F.col("run_id").isin([x for x in (before, after) if x])).collect()}
        pid = found[after]["project_id"]

        def at(run_id: str | None, table: str) -> DataFrame:
            return self.store.read_version(table, found[run_id]["counts"][f"{table}_version"] if run_id else 0, pid)

        symbols = [visible(at(r, "symbols")).select("id") for r in (before, after)]
        return graph.compare(at(before, "edges"), at(after, "edges"), *symbols)

    def change_plan(self, project_id: str, anchor: str, depth: int = 3) -> DataFrame:
        """What depends on a symbol, nearest first."""
        symbols, edges = self._graph(project_id)
        reached = templates.traverse(edges, self.spark.createDataFrame([(anchor,)], "id string"), depth=depth, reverse=True)
        return symbols.join(reached, "id").orderBy("depth", "file_path", "line_start", "id").select("id", "kind", "name", "file_path", "line_start", "depth")

    def impact(self, project_id: str, anchors: DataFrame, depth: int = 3) -> DataFrame:
        """change_plan for many symbols (id) in one job: seed, and what depends on it with its depth."""
        run_id, (symbols, edges) = new_run_id(), self._graph(project_id)
        reached = reach(edges, anchors, lambda name, df: self._staged(name, df, run_id), depth=depth, reverse=True)
        return symbols.join(reached, "id").select("seed", "id", "kind", "name", "file_path", "line_start", "depth")

    def ask_many(self, project_id: str, questions: DataFrame, k: int = 10) -> DataFrame:
        """The k nearest chunks, exactly, for each of many questions (query_id, text): query_id, rank, distance and the chunk."""
        run_id, chunks = new_run_id(), self._chunks(project_id)
        index = VectorIndex.build(chunks, f"{self.store.root}/staging/{run_id}/index")
        asked = questions.select("query_id", retrieval.embed(F.col("text")).alias("embedding"))
        found = index.search(asked, lambda name, df: self._staged(name, df, run_id), k).withColumnRenamed("id", "chunk_id")
        return found.join(chunks.select("chunk_id", "symbol_id", "chunk_type", "text", "file_path", "line_start"), "chunk_id")
