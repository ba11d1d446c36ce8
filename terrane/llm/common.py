"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word definitions of the operators use it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where it is unset, a folder of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="terrane-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read again from there.

    A lost executor costs no more than the tasks that it ran, since later jobs start from the table.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(*columns: Column, seed: int = 0) -> Column:
    """A stable 64-bit hash of a row; equal rows get equal hashes."""
    return F.xxhash64(F.lit(seed), *columns)


def unit(hashed: Column) -> Column:
    """A double in (0, 1) from a 64-bit hash."""
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(1 << 53)
