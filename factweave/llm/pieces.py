"""Long texts in pieces, so that one text never occupies one task.

Texts up to a limit are handled where they are read. A longer text is cut into
pieces of at most ``piece`` characters; the pieces become rows of their own, are
dealt over all tasks, and what each task made of them meets again by text. Equal
long texts (copies) are handled once: they share the key ``__key``, a digest of the
text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(docs: DataFrame, doc_id: str, text: str, limit: int) -> DataFrame:
    """doc_id, text (null counts as empty) and __key, which is null for texts up to the limit."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"))
    return rows.withColumn("__key", F.when(F.length("text") > limit, F.sha2("text", 256)))


def pieces_of(rows: DataFrame, piece: int, before: int = 0) -> DataFrame:
    """__key, no (from 0), part, head: the pieces of each distinct long text, dealt over all tasks, and characters before each."""
    last = F.ceil(F.length("text") / F.lit(piece)).cast("int") - 1
    cut = lambda i: F.struct(F.substring("text", i * piece + 1, F.lit(piece)).alias("part"), F.substring("text", F.greatest(i * piece - before, F.lit(0)) + 1, F.least(i * piece, F.lit(before))).alias("head"))
    texts = rows.where("__key is not null").select("__key", F.posexplode(F.transform(F.sequence(F.lit(0), last), cut)).alias("no", "cut"))
    return texts.dropDuplicates(["__key", "no"]).select("__key", "no", "cut.*")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bound what a task holds as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
