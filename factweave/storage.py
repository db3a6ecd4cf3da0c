"""Intermediate tables in the folder that the whole cluster shares.

Iterations cut their lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it back, so a lost executor never forces a
recomputation from the input. Only where the setting is absent (tests, a laptop) a
temporary folder is used.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Shuffled bytes of a task. Facts compress well: in memory, sorted, they take some hundred times as much.
_TASK_BYTES = 2 << 20


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
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_tasks(spark: SparkSession, parts: int):
    """Tables that are written within are made by tasks of bounded memory: shuffles have ``parts`` partitions at least.

    Only tables whose size is known from a shuffle are broadcast; written ones are many times their files' size.
    """
    wide = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(wide),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(_TASK_BYTES),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 << 20),
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
