"""Writers: whole or not at all, never over what is there unless asked."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cuts import file_system


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def write_new(rows: DataFrame, where: str) -> None:
    """Parquet; refuses a folder that is there (SNK-03). Spark's committer leaves no half result (SNK-02)."""
    rows.write.mode("errorifexists").parquet(where)


def _put(spark: SparkSession, where: str, data: bytes) -> None:
    """A file in place of another in one step: readers see the old one or the new."""
    fs, target = _path(spark, where)
    jvm = spark.sparkContext._jvm
    temp = jvm.org.apache.hadoop.fs.Path(f"{where}.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, target, how)


def replace(rows: DataFrame, where: str) -> None:
    """A new version below ``where``, then a pointer to it in place of the old: readers (``current``) see one or the other, and a
    failure leaves the old (SNK-02). The version before the last is kept for those who read it; older ones go."""
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    fs, path = _path(spark, f"{where}/CURRENT")
    before = _version(spark, where) if fs.exists(path) else None
    rows.write.parquet(f"{where}/{version}")
    _put(spark, f"{where}/CURRENT", version.encode())
    for status in fs.listStatus(path.getParent()):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def _version(spark: SparkSession, where: str) -> str:
    return spark.read.text(f"{where}/CURRENT", wholetext=True).first()["value"].strip()


def current(spark: SparkSession, where: str) -> DataFrame:
    """The last version that replace() put there."""
    return spark.read.parquet(f"{where}/{_version(spark, where)}")


def write_csv(rows: DataFrame, where: str) -> None:
    """CSV with a header, quoted where it must be, with a backslash before what would end a cell (SNK-01)."""
    rows.write.mode("errorifexists").option("header", True).option("escape", "\\").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(where)


def read_csv(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """What write_csv() wrote, line ends and blanks in cells too; doubles to the last bit (SRC-18). An empty text comes back as null."""
    return spark.read.schema(schema).option("header", True).option("escape", "\\").option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(where)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report's table as Markdown, cells padded (SNK-06); refuses more than ``most`` rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cells = [rows.columns, *([("" if v is None else str(v)) for v in r] for r in found)]
    wide = [max(len(line[i]) for line in cells) for i in range(len(rows.columns))]
    line = lambda parts: "| " + " | ".join(p.ljust(w) for p, w in zip(parts, wide, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, cells[1:])])


def append_last(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Both, keeping the last row of each key: rows of ``new`` come after (SNK-04)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    window = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(order).desc())
    return both.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k", "_new")


def write_receipt(spark: SparkSession, where: str, content: dict) -> None:
    """A JSON file, put in place by a rename (SNK-05, SNK-09)."""
    _put(spark, where, json.dumps(content, sort_keys=True, indent=1).encode())


def redacted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Without text columns; the row count stays (SNK-07)."""
    return rows.drop(*columns)


#: Bytes of a file that a task holds while it hashes it.
PART_BYTES = 8 << 20
#: Tasks that hash files, at most.
HASHERS = 1000


def listed(system: pafs.FileSystem, root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, or the file itself, by name; none whose name begins with . or _."""
    info = system.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    found = system.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, n_bytes) of a file or those below a folder, for freezing inputs (MTH-02, RCP-08). Each is read as a stream, so it
    may be of any size; empty ones count too. Only names go through the driver."""
    system, root = file_system(path)
    scheme = path[: path.index(root)] if root in path else ""
    names = spark.createDataFrame([(scheme + p,) for p, _ in listed(system, root)], "path string")
    names = names.repartition(max(1, min(names.count(), HASHERS)))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["path"]:
                system, where = file_system(name)
                made, n = hashlib.sha256(), 0
                with system.open_input_stream(where) as f:
                    while part := f.read(PART_BYTES):
                        made.update(part)
                        n += len(part)
                out.append((name, made.hexdigest(), n))
            yield pd.DataFrame(out, columns=["path", "sha256", "n_bytes"])

    return names.mapInPandas(digest, "path string, sha256 string, n_bytes long")


def relative(hashes: DataFrame, root: str) -> DataFrame:
    """Hashes with paths below a folder, so that a copy elsewhere compares."""
    tail = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/")) + "/"
    return hashes.withColumn("path", F.element_at(F.split(F.col("path"), re.escape(tail), 2), -1))


def frozen_changes(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) of a stored manifest against files as they are: same, changed, new or gone (RCP-08)."""
    a, b = (m.select("path", F.col("sha256").alias(name)) for m, name in ((frozen, "_a"), (now, "_b")))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))
