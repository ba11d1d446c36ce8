"""A streaming source of listings: every micro-batch is the whole listing of a folder, read in parallel.

Its offsets are times, so each trigger has a new one. A batch that is replayed lists the folder again: it brings the
newest state, which is what a follower of the folder wants. The rows are those of sources.inventory.listing.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from terrane.sources.inventory import LISTED, roots, walk


class Entry(InputPartition):
    """What one task lists: some of the root's entries."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.tasks = options["root"].rstrip("/"), int(options.get("tasks", "32"))

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        paths = roots(self.root)
        return [Entry(paths[i :: self.tasks]) for i in range(min(self.tasks, len(paths)))] or [Entry([])]

    def read(self, partition: Entry) -> Iterator[tuple]:
        return iter(walk(self.root, partition.paths))


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrane_listing"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ListingReader(self.options)
