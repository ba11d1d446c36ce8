"""Versioned Parquet tables and the registry of projects, files and runs.

A table's version is a manifest: the folders that hold each project's rows, and for some tables each bucket of them, by
a hash of file or key, so that a write of some files need not write a project's other rows again. A write adds folders for its own projects
only and then a manifest that names them in place of the old ones. A manifest is written whole under a private name, and
then given the next version's name in one step that fails if there is such a file; so every version is whole, and of
two writers that saw the same version one starts over from the other's. It fails if both wrote the same project. A write
that ends early leaves the table as it was, and no job overwrites what it reads. Tables of a row or so for each project are written
whole as one folder that all projects share (SHARED): a project that is written alone since then has its own entry, which stands before it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "projects": "project_id string, root string, name string, version string, state string, index_version int, last_indexed_at timestamp, last_run_id string",
    "files": "project_id string, path string, size long, mtime timestamp, content_hash string, language string, artifact_type string, parse_status string, last_run_id string",
    "runs": "run_id string, project_id string, state string, stage string, counts map<string,bigint>, warnings array<string>, error string, updated_at timestamp",
    "symbols": "id string, kind string, name string, fqn string, file_path string, line_start long, line_end long, language string, project_id string, last_run_id string, docstring string, source_hash string, properties map<string,string>, shadowed boolean",
    "edges": "source_id string, target_id string, target_hint string, type string, file_path string, line long, confidence string, extractor string, last_run_id string, project_id string, origin string",
    "asked": "key string, origin string, source_id string, type string, target_id string, target_hint string, file_path string, line long, confidence string, extractor string, last_run_id string, project_id string",
    "listed": "project_id string, path string, size long, mtime timestamp",
    "extracted": "file_path string, last_run_id string, project_id string",
    "chunks": "chunk_id string, symbol_id string, chunk_type string, text string, project_id string, kind string, file_path string, line_start long, embedding array<float>",
}
#: The column whose hash deals a table's rows into buckets, and their number.
BUCKET_BY, BUCKETS = {"symbols": "file_path", "edges": "file_path", "chunks": "file_path", "extracted": "file_path", "asked": "key"}, 16
#: Tables with a row or so for each project, and the manifest's entry for the folders that projects without an entry share.
SHARED, EVERY = ("projects",), "*"
# States a run can start from, and the states that may follow each.
STARTABLE = ["NEW", "IDLE", "COMPLETED", "PARTIAL", "FAILED"]
NEXT_STATES = {**{s: ["RUNNING"] for s in STARTABLE}, "RUNNING": ["COMPLETED", "FAILED", "PARTIAL"], "COMPLETED": ["RUNNING", "IDLE"], "FAILED": ["RUNNING", "IDLE"]}


def transition(state: str, to: str) -> str:
    if to not in NEXT_STATES.get(state, []):
        raise ValueError(f"a project that is {state} cannot become {to}")
    return to


class Conflict(RuntimeError):
    """Another writer changed the same project since it was read."""


def project_key(project_id: str | None) -> str:
    """Names a project in folders and manifests, whatever its id holds."""
    return hashlib.sha256((project_id or "").encode()).hexdigest()


def _key_of(project_id: Column) -> Column:
    return F.sha2(F.coalesce(project_id, F.lit("")), 256)


def _held(entries: dict[str, list[str]], key: str) -> list[str]:
    """The folders that hold a project's rows: its own, or those that all share."""
    return entries.get(key, entries.get(EVERY, []))


def bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def _bucket_of(folder: str) -> int:
    return int(folder.rsplit("bucket=", 1)[1])


class Store:
    #: Appended folders of a project from which on the next append rewrites them as one.
    MOST_FOLDERS = 100
    #: Seconds after which a manifest that cannot be read is given up.
    IN_FLIGHT_S = 5

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        """A path and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _children(self, path: str) -> list:
        fs, at = self._path(path)
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def _versions(self, name: str) -> list[str]:
        return sorted(n for f in self._children(f"{self.root}/{name}/versions") if re.fullmatch(r"v\d{12}\.json", n := f.getPath().getName()))

    def _entries(self, name: str, version: str) -> dict[str, list[str]] | None:
        """A manifest's folders by project. One that is not whole was put there by other means: it is waited for up to
        an age of IN_FLIGHT_S, and is None from then on."""
        fs, at = self._path(f"{self.root}/{name}/versions/{version}")
        while True:
            stream = fs.open(at)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                if time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > self.IN_FLIGHT_S:
                    return None
            finally:
                stream.close()
            time.sleep(0.2)

    def _newest(self, name: str) -> tuple[int, dict[str, list[str]]]:
        """The newest version's number, and the entries of the newest whole one, from one listing; 0 and none before the first."""
        versions = self._versions(name)
        entries = next((e for v in reversed(versions) if (e := self._entries(name, v)) is not None), {})
        return (int(versions[-1][1:-5]) if versions else 0), entries

    def manifest(self, name: str) -> dict[str, list[str]]:
        """The newest version: folders by project_key."""
        return self._newest(name)[1]

    def _publish(self, path: str, entries: dict[str, list[str]]) -> bool:
        """Writes a manifest whole under a private name and renames it; False if another writer has taken the name."""
        folder, name = path.rsplit("/", 1)
        fs, private = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        out = fs.create(private, False)
        out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # Its rename would overwrite; a hard link does not.
                os.link(private.toUri().getPath(), fs.makeQualified(self._path(path)[1]).toUri().getPath())
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(private, self._path(path)[1], none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        finally:
            fs.delete(private, False)

    def _commit(self, name: str, made: dict[str, list[str]], base: dict[str, list[str]], keys: set[str] | None) -> None:
        """A version with the folders made for the projects `keys` (None: for all there are), which must be as in base."""
        while True:
            number, now = self._newest(name)
            over = set(now) | set(base) if keys is None else keys
            if any(_held(now, k) != _held(base, k) for k in over):
                raise Conflict(f"{name}: another writer changed the same project")
            alone = {} if keys is None or EVERY not in now else {k: [] for k in keys}  # without rows of its own it is not to get back the shared ones
            entries = {k: v for k, v in now.items() if k not in over} | alone | made
            if self._publish(f"{self.root}/{name}/versions/v{number + 1:012d}.json", entries):
                return

    def _frame(self, name: str, entries: dict[str, list[str]], projects: tuple[str, ...], buckets: set[int] | None = None) -> DataFrame:
        own = sorted(set(entries) - {EVERY})
        keys = [project_key(p) for p in projects] or own
        folders = [f"{self.root}/{name}/rows/{f}" for k in keys for f in entries.get(k, []) if buckets is None or _bucket_of(f) in buckets]
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])
        if EVERY not in entries or projects and all(k in entries for k in keys):
            return rows
        shared, key = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{name}/rows/{f}" for f in entries[EVERY]]), _key_of(F.col("project_id"))
        if projects:
            shared = shared.filter(key.isin(*[k for k in keys if k not in entries]))
        elif own:
            shared = shared.filter(~key.isin(*own))
        return rows.unionByName(shared) if folders else shared

    def read(self, name: str, *projects: str, buckets: set[int] | None = None) -> DataFrame:
        """Rows of some projects, from their own folders, or of all; of some buckets, or of all."""
        return self._frame(name, self.manifest(name), projects, buckets)

    def version(self, name: str) -> int:
        """The number of a table's newest version; 0 before the first."""
        return self._newest(name)[0]

    def read_version(self, name: str, number: int, *projects: str) -> DataFrame:
        """Rows as of a version; of none before the first. A version that was vacuumed cannot be read."""
        return self._frame(name, (self._entries(name, f"v{number:012d}.json") or {}) if number else {}, projects)

    def buckets(self, name: str, rows: DataFrame) -> set[int]:
        """The buckets of rows that have the table's bucket column: at most BUCKETS."""
        return {r["b"] for r in rows.select(bucket(F.col(BUCKET_BY[name])).alias("b")).distinct().collect()}

    def _add(self, name: str, df: DataFrame, whole: bool = False) -> dict[str, list[str]]:
        """Writes rows that no version names yet. whole: they are all rows of the table."""
        target, folder = self.spark.createDataFrame([], SCHEMAS[name]).schema, uuid.uuid4().hex
        given = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target]
        if whole and name in SHARED:
            df.select(*given).write.parquet(f"{self.root}/{name}/rows/{folder}")
            return {EVERY: [folder]}
        rows, by = df.select(*given, _key_of(F.col("project_id")).alias("project_key")), ["project_key"]
        if name in BUCKET_BY:
            # Rebalanced, a bucket is not a file of every task; a large one is still written by several.
            rows, by = rows.withColumn("bucket", bucket(F.col(BUCKET_BY[name]))), ["project_key", "bucket"]
            rows = rows.hint("rebalance", *by)
        rows.write.partitionBy(*by).parquet(f"{self.root}/{name}/rows/{folder}")
        made = [folder]
        for _ in by:
            made = [f"{m}/{n}" for m in made for f in self._children(f"{self.root}/{name}/rows/{m}") if "=" in (n := f.getPath().getName())]
        out: dict[str, list[str]] = {}
        for m in made:
            out.setdefault(m.split("/")[1].split("=")[1], []).append(m)
        return out

    def write(self, name: str, df: DataFrame, *projects: str, base: dict[str, list[str]] | None = None, buckets: set[int] | None = None) -> DataFrame:
        """df in place of the rows of these projects (of some of their buckets), or of the whole table. df may hold such rows only.

        base: the manifest that df was made from, where another writer's change since then must not be lost.
        """
        base = self.manifest(name) if base is None else base
        keys, made = {project_key(p) for p in projects} or None, self._add(name, df, not projects)
        if keys is not None and not keys >= set(made):
            raise ValueError(f"{name}: rows of other projects than those to write")
        if buckets is not None:
            if any(_bucket_of(f) not in buckets for folders in made.values() for f in folders):
                raise ValueError(f"{name}: rows of other buckets than those to write")
            made = {k: [f for f in base.get(k, []) if _bucket_of(f) not in buckets] + made.get(k, []) for k in keys}
        self._commit(name, made, base, keys)
        return self.read(name, *projects)

    def append(self, name: str, df: DataFrame, project_id: str) -> None:
        """More rows of a project; its old ones are not written again, but for every MOST_FOLDERS appends."""
        key = project_key(project_id)
        while True:
            base = self.manifest(name)
            whole = len({f.split("/")[0] for f in base.get(key, [])}) >= self.MOST_FOLDERS or key not in base and EVERY in base
            made = self._add(name, self._frame(name, base, (project_id,)).unionByName(df) if whole else df)
            try:
                return self._commit(name, {key: ([] if whole else base.get(key, [])) + made.get(key, [])}, base, {key})
            except Conflict:  # Appends go well with each other.
                continue

    def replace(self, name: str, new: DataFrame, key: list[str], base: dict[str, list[str]] | None = None) -> DataFrame:
        """INSERT OR REPLACE: new rows, and old ones whose key has no new row. Only projects of new rows are written."""
        base = self.manifest(name) if base is None else base
        projects = [r["project_id"] for r in new.select("project_id").distinct().collect()]
        if not projects:
            return self.read(name)
        old = self._frame(name, base, tuple(projects))
        kept = old.join(new.select(*key), key, "left_anti").select(old.columns)
        return self.write(name, new.select(old.columns).unionByName(kept), *projects, base=base)

    def vacuum(self, name: str, keep: int = 2, older_than_s: int = 86_400) -> int:
        """Deletes all but the last `keep` versions and, past an age that spares writes under way, folders none of them names."""
        versions, before = self._versions(name), (time.time() - older_than_s) * 1000
        used = {f.split("/")[0] for v in versions[-keep:] for fs in (self._entries(name, v) or {}).values() for f in fs}
        gone = [f"{self.root}/{name}/versions/{v}" for v in versions[:-keep]]
        gone += [str(f.getPath()) for f in self._children(f"{self.root}/{name}/rows") if f.getPath().getName() not in used and f.getModificationTime() <= before]
        for path in gone:
            fs, at = self._path(path)
            fs.delete(at, True)
        return len(gone)

    def project(self, project_id: str) -> DataFrame:
        return self.read("projects", project_id)

    def files(self, project_id: str) -> DataFrame:
        return self.read("files", project_id)

    def list_projects(self) -> DataFrame:
        return self.read("projects").orderBy(F.col("last_indexed_at").desc(), "project_id")

    def log_run(self, run_id: str, project_id: str, state: str, stage: str, counts: dict | None = None, warnings: list[str] | None = None, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(run_id, project_id, state, stage, counts or {}, warnings or [], error)], "run_id string, project_id string, state string, stage string, counts map<string,bigint>, warnings array<string>, error string").withColumn("updated_at", F.current_timestamp())
        self.append("runs", row, project_id)

    def runs(self) -> DataFrame:
        return latest(self.read("runs"), ["run_id"], "updated_at")

    def set_state(self, project_id: str, to: str, **columns) -> None:
        base = self.manifest("projects")
        row = self._frame("projects", base, (project_id,))
        transition(row.select("state").first()["state"], to)
        changed = row.withColumn("state", F.lit(to))
        for name, value in columns.items():
            changed = changed.withColumn(name, value)
        self.replace("projects", changed, ["project_id"], base)


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of an append-only log, the last row of each key."""
    return log.groupBy(*key).agg(F.max_by(F.struct(*log.columns), F.col(order)).alias("row")).select("row.*")


def new_run_id() -> str:
    return uuid.uuid4().hex
