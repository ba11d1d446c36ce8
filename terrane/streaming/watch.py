"""Incremental indexing as a stream: of rows of files, and of a folder that is listed over and over."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrane.operators.diff import changed, snapshot_diff
from terrane.operators.store import Store, latest
from terrane.streaming.listing import ListingSource

if TYPE_CHECKING:
    from terrane.engine import Engine

FILES = "project_id string, path string, size long, mtime timestamp, content_hash string, language string, artifact_type string, parse_status string"


def watch(stream: DataFrame, store: Store, checkpoint: str, index: Callable[[DataFrame, str], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Merges a stream of file rows (FILES) into the registry, and calls index(changed rows, run id) for each batch.

    The run id is the batch's number, so a batch that is replayed after a failure changes nothing. A file stream shows
    no deletions: a full index finds those.
    """

    def merge(batch: DataFrame, number: int) -> None:
        run_id = f"batch-{number}"
        rows = latest(batch, ["project_id", "path"], "mtime")
        known = store.read("files")
        keys = changed(snapshot_diff(rows, known.join(rows.select("project_id", "path"), ["project_id", "path"], "left_semi")))
        new = rows.join(keys.select("project_id", "path"), ["project_id", "path"], "left_semi").withColumn("last_run_id", F.lit(run_id))
        store.replace("files", new, ["project_id", "path"])
        if index is not None:
            index(new, run_id)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def follow(engine: Engine, root: str, checkpoint: str, available_now: bool = True, every: str = "10 seconds", version: str | None = None) -> StreamingQuery:
    """Indexes a folder as it changes: each micro-batch is a listing, held against the paths, sizes and times of the registry.

    So new, changed and deleted files show. A listing without a change writes nothing and reads no content, and so does a
    batch that is replayed after it was merged; one that changed something is merged like a run of Engine.index.
    """
    engine.spark.dataSource.register(ListingSource)
    stream = engine.spark.readStream.format("terrane_listing").option("root", root).load()

    def merge(batch: DataFrame, _: int) -> None:
        engine.index(root, version=version, listed=batch)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
