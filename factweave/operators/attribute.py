"""Row-level operators on facts: as-of attribution, merging, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_name(facts: DataFrame, symbols: DataFrame, file: str = "file", name: str = "fn_name", kinds=("function",)) -> DataFrame:
    """Each fact gets the name of the last symbol at or above its line in its file; else its name stays.

    A backward as-of join as one window over both tables: linear after the sort. Of
    symbols on one line the largest name counts.
    """
    marks = symbols.where(F.col("kind").isin(*kinds)).groupBy(F.col("file").alias("__file"), F.col("line").alias("__line")).agg(F.max("name").alias("__name"))
    rows = facts.select(F.struct("*").alias("__row"), F.col(file).alias("__file"), F.col("line").alias("__line"), F.lit(None).cast("string").alias("__name"), F.lit(1).alias("__tag"))
    both = rows.unionByName(marks.select(F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "__file", "__line", "__name", F.lit(0).alias("__tag")))
    before = Window.partitionBy("__file").orderBy("__line", "__tag").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__name", ignorenulls=True).over(before)).where("__tag = 1")
    return found.select("__row.*", "__found").withColumn(name, F.coalesce("__found", name)).drop("__found")


def attribute_events(events: DataFrame, symbols: DataFrame) -> DataFrame:
    return asof_name(events, symbols)


def attribute_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges without a source symbol get the enclosing function or class."""
    own = edges.where("src_symbol is not null or line is null")
    return own.unionByName(asof_name(edges.where("src_symbol is null and line is not null"), symbols, "src_file", "src_symbol", ("function", "class")))


def merge_first_wins(events: DataFrame, compat: bool = True) -> DataFrame:
    """Call-layer events stay; a pattern event only if no earlier one has its (file, line, medium).

    Without ``compat`` events differ also by key and direction, so a query of two
    tables keeps both.
    """
    key = ["file", F.coalesce("line", F.lit(-1)), "medium"] + ([] if compat else ["key_norm", "direction"])
    first = F.row_number().over(Window.partitionBy(*key).orderBy("ord", "key_norm"))
    return events.withColumn("__n", first).where("__n = 1 or prov_source <> 'regex'").drop("__n")


def confidence_filter(events: DataFrame, least: float = 0.5) -> DataFrame:
    return events.where(F.col("prov_confidence") >= least)


def verifiable(events: DataFrame, media=("redis", "kafka", "sql", "http_header")) -> DataFrame:
    return events.where((F.col("prov_source") != "regex") & F.col("line").isNotNull() & F.col("medium").isin(*media))


def overlay_verdicts(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Confidence and note of the last verdict (by ord) on (fn_name, file, medium, key_norm)."""
    key = ["fn_name", "file", "medium", "key_norm"]
    last = verdicts.groupBy(*key).agg(F.max_by(F.struct("confidence", "note"), "ord").alias("__v"))
    joined = events.join(last, key, "left")
    return joined.withColumn("prov_confidence", F.coalesce("__v.confidence", "prov_confidence")).withColumn("prov_note", F.col("__v.note")).drop("__v")
