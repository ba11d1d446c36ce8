"""File inventories: a listing in tasks, ignore rules, scope and size gate on names, then one read of what is left.

The root's entries are listed on the driver; tasks list what is below them, hidden and empty files too, and do not enter
folders that are never scanned. Contents are read in tasks after the filters.
"""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.paths import IGNORED_DIRS, classify, ignored, ignored_by, in_scope, parse_status

LISTED = "path string, relative string, size long, mtime timestamp"


def project_id(root: str) -> str:
    return "proj_" + hashlib.sha256(str(PurePosixPath(root)).encode()).hexdigest()[:12]


def allowed(root: str, prefixes: list[str]) -> bool:
    """Whether a root lies in one of the prefixes, on whole path segments; no prefixes allow all."""
    path = PurePosixPath(root)
    return not prefixes or any(path == PurePosixPath(p) or PurePosixPath(p) in path.parents for p in prefixes)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _entries(system, folder: str) -> list:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder))
    return [x for x in found if x.type != fs.FileType.Directory or x.base_name not in IGNORED_DIRS]


def roots(root: str) -> list[str]:
    """The entries of a root, which tasks list from there."""
    system, base = _system(root.rstrip("/"))
    return sorted(x.path for x in _entries(system, base))


def walk(root: str, paths: list[str]) -> list[tuple]:
    """path, relative, size and mtime of the files at and below some paths of a root."""
    from pyarrow import fs

    system, base = _system(root.rstrip("/"))
    rows, open_ = [], system.get_file_info(paths) if paths else []
    while open_:
        x = open_.pop()
        if x.type == fs.FileType.Directory:
            open_ += _entries(system, x.path)
        elif x.type == fs.FileType.File:
            rows.append((x.path, x.path[len(base) :].lstrip("/"), x.size, x.mtime))
    return rows


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, relative, size, mtime of every file below a root; folders named in IGNORED_DIRS are not entered."""
    first = [(p,) for p in roots(root)]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(walk(root, pdf["path"].tolist()), columns=["path", "relative", "size", "mtime"])

    return spark.createDataFrame(first, "path string").repartition(max(1, len(first))).mapInPandas(listed, LISTED)


def contents(files: DataFrame, root: str) -> DataFrame:
    """files with content; null, and readable false, where a file cannot be read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _system(root.rstrip("/"))
        for pdf in batches:
            said = []
            for path in pdf["path"]:
                try:
                    with system.open_input_stream(path) as stream:
                        said.append(stream.read())
                except OSError:
                    said.append(None)
            yield pdf.assign(content=pd.Series(said, dtype=object, index=pdf.index), readable=[x is not None for x in said])

    return files.mapInPandas(read, f"{LISTED}, content binary, readable boolean")


def detect_version(spark: SparkSession, root: str, files: DataFrame | None = None) -> str:
    """2.x or 3.x by application.properties, else build.gradle, else BuildConfig.groovy; else unknown."""
    names = ["application.properties", "build.gradle", "grails-app/conf/BuildConfig.groovy"]
    files = contents((listing(spark, root) if files is None else files).filter(F.col("relative").isin(names)), root)
    number = F.regexp_extract(F.col("content").cast("string"), r"(?m)^\s*app\.grails\.version\s*[=:]\s*([23])\.", 1)
    has = [F.max((F.col("relative") == x).cast("int")).alias(a) for x, a in ((names[1], "gradle"), (names[2], "config"))]
    row = files.agg(F.max(F.when(F.col("relative") == names[0], number)).alias("n"), *has).first()
    if row["n"]:
        return f"{row['n']}.x"
    return "3.x" if row["gradle"] else "2.x" if row["config"] else "unknown"


def scan(
    spark: SparkSession, root: str, version: str, scope: str = "full", patterns: tuple[str, ...] = (), most_mb: int = 5, project: str | None = None, files: DataFrame | None = None
) -> DataFrame:
    """project_id, path, size, mtime, content_hash, language, artifact_type, parse_status, content (null for oversize and unreadable files).

    Rules, scope and size are applied to the listing; contents of other files are never read.
    """
    path = F.col("relative")
    kept = (listing(spark, root) if files is None else files).filter(~ignored(path, F.lit(version)) & ~ignored_by(path, list(patterns)) & in_scope(path, scope))
    small = contents(kept.filter(F.col("size") <= most_mb << 20), root)
    large = kept.filter(F.col("size") > most_mb << 20).withColumns({"content": F.lit(None).cast("binary"), "readable": F.lit(True)})
    out = small.unionByName(large).withColumn("_c", classify(path, F.lit(version)))
    return out.select(
        F.lit(project or project_id(root)).alias("project_id"), path.alias("path"), "size", "mtime", F.sha2("content", 256).alias("content_hash"),
        "_c.language", "_c.artifact_type", parse_status(F.col("size"), F.col("readable"), most_mb).alias("parse_status"), "content",
    )


def ignore_patterns(spark: SparkSession, root: str, files: DataFrame | None = None) -> tuple[str, ...]:
    """Lines of the root's two ignore files."""
    files = (listing(spark, root) if files is None else files).filter(F.col("relative").isin(".gitignore", ".mcpignore"))
    rows = contents(files, root).orderBy("relative").select(F.col("content").cast("string").alias("text")).collect()
    return tuple(line for r in rows for line in (r["text"] or "").splitlines())


def git_scope(root: str, revisions: str) -> str:
    """files:A\\0B of the paths that changed in a range of revisions."""
    out = subprocess.run(["git", "-C", root, "diff", "--name-only", "-z", revisions], capture_output=True, text=True, check=True)
    return "files:" + out.stdout.rstrip("\0")
