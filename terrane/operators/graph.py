"""Graph tables as values: upserts, deletions and the dangling sweep return new DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ["source_id", "type", "target_id", "target_hint", "file_path", "line"]


def upsert_nodes(old: DataFrame, new: DataFrame, run_id: str) -> DataFrame:
    """New nodes, stamped with the run, and the old ones that have no new version. Of equal new ids, the last line's stays."""
    order = F.struct("line_start", F.to_json(F.struct(*new.columns)))
    once = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), order).alias("row")).select("row.*")
    return once.withColumn("last_run_id", F.lit(run_id)).unionByName(old.join(once.select("id"), "id", "left_anti"))


def with_shadows(versions: DataFrame) -> DataFrame:
    """Symbols of several files with shadowed: of those with one id, the first by file counts. Of one id in one file, the last line's stays."""
    said = [c for c in versions.columns if c not in ("last_run_id", "shadowed")]
    once = versions.groupBy("id", "file_path").agg(F.max_by(F.struct(*versions.columns), F.struct("line_start", F.to_json(F.struct(*said)))).alias("row")).select("row.*")
    first = once.groupBy(F.col("id").alias("_id")).agg(F.min("file_path").alias("_file"))
    return once.join(first, F.col("id") == F.col("_id")).withColumn("shadowed", F.col("file_path") != F.col("_file")).drop("_id", "_file")


def upsert_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: inserted, updated."""
    ids = new.select("id").distinct().join(old.select("id", F.lit(True).alias("held")).distinct(), "id", "left")
    return ids.agg(F.count_if(F.col("held").isNull()).alias("inserted"), F.count_if(F.col("held")).alias("updated"))


def upsert_edges(old: DataFrame, new: DataFrame, symbols: DataFrame, run_id: str) -> DataFrame:
    """Edges whose source is a symbol, once for each key; a null confidence is UNRESOLVED, an empty target null."""
    ids = symbols.select(F.col("id").alias("source_id"))
    kept = (
        new.filter(F.col("source_id") != "").join(ids, "source_id", "left_semi")
        .withColumn("target_id", F.when(F.col("target_id") != "", F.col("target_id")))
        .withColumn("confidence", F.coalesce("confidence", F.lit("UNRESOLVED")))
        .withColumn("last_run_id", F.lit(run_id))
    )
    both = kept.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    order = F.struct("_new", F.to_json(F.struct(*[c for c in old.columns if c != "last_run_id"])))
    return both.groupBy(*EDGE_KEY).agg(F.max_by(F.struct(*old.columns), order).alias("row")).select("row.*")


def without_incident(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end in `gone` (id): two anti joins, no join on an OR."""
    return edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(edges.columns)


def stale(symbols: DataFrame, files: DataFrame, run_id: str) -> DataFrame:
    """Symbols of the touched files that carry an older run."""
    return symbols.join(files.select("file_path").distinct(), "file_path", "left_semi").filter(~F.col("last_run_id").eqNullSafe(F.lit(run_id))).select(symbols.columns)


def delete_stale(symbols: DataFrame, edges: DataFrame, files: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    gone = stale(symbols, files, run_id)
    return symbols.join(gone.select("id"), "id", "left_anti").select(symbols.columns), without_incident(edges, gone)


def delete_files(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = symbols.join(files.select("file_path").distinct(), "file_path", "left_semi")
    return symbols.join(gone.select("id"), "id", "left_anti").select(symbols.columns), without_incident(edges, gone)


def dangling_sweep(edges: DataFrame, symbols: DataFrame, deleted_files: DataFrame | None = None) -> DataFrame:
    """edges with action (delete, downgrade, keep), warning_code and dangling; downgraded rows are unresolved already."""
    ids = symbols.select("id").distinct()
    out = edges.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")), "source_id", "left").join(ids.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left")
    in_deleted = F.lit(False)
    if deleted_files is not None:
        out = out.join(deleted_files.select("file_path", F.lit(True).alias("_f")).distinct(), "file_path", "left")
        in_deleted = F.col("_f").isNotNull()
    lost = F.col("target_id").isNotNull() & F.col("_t").isNull()
    action = F.when(in_deleted | F.col("_s").isNull(), "delete").when(lost & (F.col("confidence") == "EXACT"), "downgrade").otherwise("keep")
    warning = F.when(F.col("type") == "CALLS", "ambiguous_call").when(F.col("type") == "INJECTS", "unresolved_di").when(F.col("type").isin("EXTENDS", "IMPLEMENTS", "USES_TYPE"), "missing_symbol")
    out = out.withColumn("action", action).withColumn("dangling", lost)
    down = F.col("action") == "downgrade"
    out = out.withColumn("warning_code", F.when(down, warning)).withColumn("confidence", F.when(down, "UNRESOLVED").otherwise(F.col("confidence"))).withColumn("target_id", F.when(~down, F.col("target_id")))
    return out.select(*edges.columns, "action", "warning_code", "dangling")


def compare(old: DataFrame, new: DataFrame, old_ids: DataFrame, new_ids: DataFrame, key: tuple[str, ...] = ("origin",)) -> DataFrame:
    """Edges that differ between two graphs: the key, type, source_id, file_path, line, change, cause, old_target and new_target.

    change: opened (no target any more, or a new edge without one), closed (a target now, or an edge without one that is
    gone), moved (another target), added and removed (with a target). cause: edge_added, edge_removed, target_removed (it
    is no symbol any more), target_added (it was none), else ambiguity (other symbols of its names came or went).
    """
    about = ["type", "source_id", "file_path", "line"]
    side = lambda df, name: df.select(*key, F.struct("target_id", *about).alias(name))
    both = side(old, "was").join(side(new, "is"), list(key), "full")
    was, now = F.col("was.target_id"), F.col("is.target_id")
    both = both.filter(F.col("was").isNull() | F.col("is").isNull() | ~was.eqNullSafe(now)).select(*key, "was", "is", was.alias("old_target"), now.alias("new_target"))
    gone = both.join(new_ids.select(F.col("id").alias("_new"), F.lit(True).alias("_stays")).distinct(), F.col("old_target") == F.col("_new"), "left")
    told = gone.join(old_ids.select(F.col("id").alias("_old"), F.lit(True).alias("_was")).distinct(), F.col("new_target") == F.col("_old"), "left")
    came, went = F.col("was").isNull(), F.col("is").isNull()
    change = (
        F.when(came, F.when(F.col("new_target").isNull(), "opened").otherwise("added")).when(went, F.when(F.col("old_target").isNull(), "closed").otherwise("removed"))
        .when(F.col("new_target").isNull(), "opened").when(F.col("old_target").isNull(), "closed").otherwise("moved")
    )
    cause = (
        F.when(came, "edge_added").when(went, "edge_removed").when(F.col("old_target").isNotNull() & F.col("_stays").isNull(), "target_removed")
        .when(F.col("new_target").isNotNull() & F.col("_was").isNull(), "target_added").otherwise("ambiguity")
    )
    return told.select(*key, *[F.coalesce(f"is.{c}", f"was.{c}").alias(c) for c in about], change.alias("change"), cause.alias("cause"), "old_target", "new_target")
