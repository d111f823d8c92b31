"""What the operators of this subpackage share: tables, the shared folder, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, ``[\x20\x09-\x0D]``, and its complement as Java patterns.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch. With texts of up to megabytes, a batch of Spark's default size would not fit a worker.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let at most ``rows`` rows go to a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, if all run on
    this machine; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="tremolo-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder, for one run of one operator."""
    return f"{shared_dir(spark)}/tremolo/{what}-{uuid.uuid4().hex}"


#: Tables that the operator at work has written, and whether its result still reads them.
_written: ContextVar[list[tuple[str, bool]] | None] = ContextVar("written", default=None)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it back, so a lost executor costs no earlier stage.

    Unlike a checkpoint, the table read has the size of its files, not a product of the sizes of all that went into it, by which
    later joins are planned. ``keep``: the result reads it; others go when the operator (see ``tidy``) is done.
    """
    where = work_dir(df.sparkSession, "cut")
    df.write.parquet(where)
    if (written := _written.get()) is not None:
        written.append((where, keep))
    return df.sparkSession.read.schema(df.schema).parquet(where)


def tidy(operator):
    """An operator whose tables are deleted when it returns, but for those that its result reads."""

    @wraps(operator)
    def run(*args, **kwargs):
        token = _written.set(written := [])
        done = False
        try:
            result = operator(*args, **kwargs)
            done = True
            return result
        finally:
            _written.reset(token)
            gone = [where for where, keep in written if not (keep and done)]
            if gone and (spark := SparkSession.getActiveSession()) is not None:
                conf = spark.sparkContext._jsc.hadoopConfiguration()
                for where in gone:
                    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
                    path.getFileSystem(conf).delete(path, True)

    return run


def looked_up(rows: DataFrame, table: DataFrame, key: str, values: list[str], times: str, most: int) -> DataFrame:
    """``rows`` with the ``values`` of a written table (key, times, values), a row a key at most; null where it has none, or the key is.

    A table of ``most`` rows is broadcast. Of a larger one those keys are that many rows share, ``most`` of them at most; other rows
    meet theirs in a shuffle, in which rows that look for nothing go by a number of their own.
    """
    n, total = table.agg(F.count("*"), F.coalesce(F.sum(times), F.lit(0))).first()
    told = lambda part, name: part.select(F.col(key).alias("_key"), F.struct(*values).alias(name))
    if n <= most:
        return rows.join(F.broadcast(told(table, "_told")), F.col(key) == F.col("_key"), "left").select(*rows.columns, *[F.col(f"_told.{v}").alias(v) for v in values])
    often = F.col(times) > total // max(1, most)
    hot, cold = told(table.where(often), "_hot"), told(table.where(~often), "_cold")
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").drop("_key")
    looks = F.col("_hot").isNull() & F.col(key).isNotNull()
    spread = F.when(looks, F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    marked = marked.withColumns({"_spread": spread, "_look": F.when(looks, F.col(key)).otherwise("")})
    found = marked.join(cold.withColumn("_zero", F.lit(0).cast("long")), (F.col("_look") == F.col("_key")) & (F.col("_spread") == F.col("_zero")), "left")
    return found.select(*rows.columns, *[F.coalesce(f"_hot.{v}", f"_cold.{v}").alias(v) for v in values])


def file_system(where: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (local, hdfs, s3, gs) and the path within it. Works on any executor."""
    if "://" not in where and not where.startswith("file:"):
        return pafs.LocalFileSystem(), where
    if where.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + where[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(where)


def put_file(where: str, name: str, parts: list[bytes]) -> int:
    """Write a file whole or not at all: under a name of this attempt, then renamed. A retried task writes the same bytes."""
    fs, folder = file_system(where)
    fs.create_dir(folder, recursive=True)
    attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with fs.open_output_stream(attempt) as out:
        for part in parts:
            size += len(part)
            out.write(part)
    fs.move(attempt, f"{folder}/{name}")
    return size


def release() -> None:
    """Give back what this worker has freed: it will be idle, or serve another operator, and its executor counts what it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # another C library than glibc
        pass


def text_of(column: str = "text") -> F.Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
