"""The registry that query modules add to: name -> query, name -> SQL that it must equal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='terrane-')}/store-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """A table of its own in the shared folder: what several branches of a plan read is computed once."""
    path = f"{scratch(df.sparkSession)}/staged"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
