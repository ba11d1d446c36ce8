"""Snapshot diff of a file inventory by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.paths import in_scope

KEY = ["project_id", "path"]


def snapshot_diff(current: DataFrame, previous: DataFrame, scope: str = "full", force: bool = False, key: list[str] = KEY) -> DataFrame:
    """key, content_hash, previous_hash and status: created, modified, unchanged or deleted.

    Both sides have the key and content_hash; one full outer join. Hashes compare null-safely (an unreadable file
    stays unchanged). Both sides are restricted to the scope, so that what is out of it is no deletion. With
    `force`, all that is there now is modified.
    """
    limit = in_scope(F.col(key[-1]), scope)
    now = current.filter(limit).select(*key, "content_hash", F.lit(True).alias("_now"))
    then = previous.filter(limit).select(*key, F.col("content_hash").alias("previous_hash"), F.lit(True).alias("_then"))
    here, before = F.col("_now").isNotNull(), F.col("_then").isNotNull()
    status: Column = F.when(~here, "deleted")
    if force:
        status = status.when(here, "modified")
    status = status.when(~before, "created").when(F.col("content_hash").eqNullSafe(F.col("previous_hash")), "unchanged").otherwise("modified")
    return now.join(then, key, "full").select(*key, "content_hash", "previous_hash", status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """One row: created, modified, unchanged, deleted, total_scanned."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return diff.agg(*map(of, ("created", "modified", "unchanged", "deleted")), F.count_if(F.col("status") != "deleted").alias("total_scanned"))


def changed(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status").isin("created", "modified"))
