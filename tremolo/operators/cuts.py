"""Tables that an operator writes for itself: they cut its lineage, so that a step costs a scan and a lost executor no earlier step."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, what: str) -> str:
    """A new name below the folder that driver and executors share, spark.checkpoint.dir; a temporary one only where all is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="tremolo-")
    return f"{where.rstrip('/')}/tremolo/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table of files and its folder, for a result that reads it: it stays for whoever owns the shared folder."""
    where = folder(rows.sparkSession, "kept")
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where), where


@contextmanager
def written(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows as a table of files, which goes when the block ends."""
    spark = rows.sparkSession
    where = folder(spark, "cut")
    try:
        rows.write.parquet(where)
        yield spark.read.schema(rows.schema).parquet(where)
    finally:
        delete(spark, where)


def file_system(where: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path within it, on any executor."""
    if "://" not in where and not where.startswith("file:"):
        return pafs.LocalFileSystem(), where
    if where.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + where[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(where)
