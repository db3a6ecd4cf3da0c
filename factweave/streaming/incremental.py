"""Incremental indexing as a stream: only files that are new or changed since the last run.

A file-source stream with ``availableNow`` keeps in its checkpoint which table files it
has read; each run hands the rows that came since to ``apply``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.files import FILES


def changed_files(spark: SparkSession, table: str) -> DataFrame:
    """Stream of (file, language, src, sha256) rows that are added to a Parquet folder."""
    return spark.readStream.schema(FILES).parquet(table)


def latest(files: DataFrame) -> DataFrame:
    """Of rows of one file the one with the largest digest; a batch may hold a file twice."""
    return files.groupBy("file").agg(F.max_by(F.struct("language", "src", "sha256"), "sha256").alias("f")).select("file", "f.*")


def run_available(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Handles all rows that are there and stops; a batch is applied again if a run was cut short."""
    query = stream.writeStream.foreachBatch(lambda batch, number: apply(latest(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
