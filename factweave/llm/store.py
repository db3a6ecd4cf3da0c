"""Intermediate tables in the folder that the whole cluster shares.

Iterations and multi-pass operators cut their lineage by writing a Parquet table
below ``spark.checkpoint.dir`` and reading it back, so a lost executor never
forces a recomputation from the input. The setting is read from the session;
only where it is unset (tests, a laptop) a temporary folder is used.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_STAGE = "stage-"
_prefix = [""]
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="factweave-")
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The table stays there: the returned frame is lazy and may be read at any time
    later. ``release`` removes all tables of an application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave-{spark.sparkContext.applicationId}/{_prefix[-1]}{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, in buckets of ``key``: rows of large values meet others of their key without a shuffle of their own."""
    spark = df.sparkSession
    table = f"factweave_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/factweave-{spark.sparkContext.applicationId}/{_prefix[-1]}{name}-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    written = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files, which the frame reads, stay
    return written


@contextlib.contextmanager
def stage_tables(spark: SparkSession):
    """Tables that are written within belong to one stage of a pipeline; those of earlier stages are deleted first.

    A stage's input must be written before the next stage begins, as the pipeline does.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/factweave-{spark.sparkContext.applicationId}/{_STAGE}*")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(top) or ():
        files.delete(found.getPath(), True)
    _prefix.append(_STAGE)
    try:
        yield
    finally:
        _prefix.pop()


def release(spark: SparkSession) -> None:
    """Delete every table that this application has written with ``materialize``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/factweave-{spark.sparkContext.applicationId}")
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for an application.

    Clusters where it is installed don't need this; it does no harm there.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="factweave-zip-")) / "factweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((top / "factweave").rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(target))  # goes out through the driver's file server
    _shipped.add(app)
