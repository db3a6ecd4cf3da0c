"""Source trees as tables, snapshots of them, and the report file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import rules as R
from factweave.functions import scalars as S

FILES = "file string, language string, src string, sha256 string"


def list_files(root: str) -> Iterator[str]:
    """Paths below root of registered extensions; hidden and generated folders aren't entered, links not followed."""
    for folder, inside, names in os.walk(root, followlinks=False):
        inside[:] = sorted(d for d in inside if not d.startswith(".") and d not in R.SKIP_DIRS)
        for name in sorted(names):
            path = Path(folder, name)
            if path.suffix[1:].lower() in R.EXTENSIONS and path.is_file() and not path.is_symlink():
                yield os.path.relpath(path, root)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """file, language, src, sha256 of a tree that every executor can read; files that can't be read are left out."""
    paths = spark.createDataFrame([(p,) for p in list_files(root)], "file string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                try:
                    data = Path(root, name).read_bytes()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"file": [name], "content": [data]}, schema=pa.schema([("file", pa.string()), ("content", pa.binary())]))

    n = max(1, min(paths.count() // 64 + 1, 4096))
    rows = paths.repartition(n).mapInArrow(read, "file string, content binary")
    return with_source(rows)


def with_source(rows: DataFrame) -> DataFrame:
    """From (file, content): language, src (empty for invalid UTF-8) and sha256."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.lit(""))
    return rows.select("file", S.language_of(F.col("file")).alias("language"), text.alias("src"), F.sha2("content", 256).alias("sha256"))


def snapshot_status(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """file, sha256, status against an earlier (file, sha256): New, Changed or Unchanged."""
    old = snapshot.select("file", F.col("sha256").alias("before"))
    status = F.when(F.col("before").isNull(), F.lit("New")).when(F.col("before") != F.col("sha256"), F.lit("Changed")).otherwise(F.lit("Unchanged"))
    return files.join(old, "file", "left").select("file", "sha256", status.alias("status"))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, of whatever file system Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_snapshot(files: DataFrame, path: str) -> None:
    files.select("file", "sha256").write.mode("overwrite").parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """One text file of the report's lines in order: the report is small next to the tree."""
    rows = lines.orderBy("section", "part", "position").select("line").toLocalIterator()
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(f"{r['line']}\n" for r in rows)
