"""Entry points: exported leaves and hints, merged, with routes carried to their handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.storage import materialize

LEAF_CONFIDENCE = 0.70


def exported_leaves(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported symbols whose name nothing calls, one for each (name, file): the first line."""
    called = edges.where("rel = 'calls' and dst_symbol is not null").select(F.col("dst_symbol").alias("name")).distinct()
    return symbols.where("is_exported").join(called, "name", "left_anti").groupBy(F.col("name").alias("fn_name"), "file").agg(F.min("line").alias("line"))


def merge_entry_points(leaves: DataFrame, hints: DataFrame) -> DataFrame:
    """One row for each (fn_name, file): highest confidence, last kind that isn't leaf, first framework, path
    and method that are there, distinct heuristics in order, first middleware that isn't empty."""
    none = F.lit(None).cast("string")
    first = leaves.select(
        "fn_name", "file", "line", F.lit("leaf").alias("kind"), none.alias("framework"), none.alias("path"), none.alias("method"),
        F.lit(LEAF_CONFIDENCE).alias("confidence"), F.lit("exported_leaf").alias("heuristic"), F.array().cast("array<string>").alias("middleware"), F.lit(-1).alias("ord"),
    )
    rows = first.unionByName(hints.select(*first.columns))
    # a total order: rule, line, then text
    order = F.struct("ord", F.coalesce("line", F.lit(0)), F.coalesce("path", F.lit("")), F.coalesce("method", F.lit("")))
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    marks = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("heuristic").alias("h"))))
    return rows.groupBy("fn_name", "file").agg(
        F.min_by("line", order).alias("line"),
        F.coalesce(F.max_by("kind", F.when(F.col("kind") != "leaf", order)), F.lit("leaf")).alias("kind"),
        pick("framework"),
        pick("path"),
        pick("method"),
        F.max("confidence").alias("confidence"),
        F.array_distinct(F.transform(marks, lambda m: m["h"])).alias("heuristics"),
        F.coalesce(F.min_by("middleware", F.when(F.size("middleware") > 0, order)), F.array().cast("array<string>")).alias("middleware"),
    )


def propagate_routes(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """A route that a router file states is copied to the handler's entry point in the file that defines it.

    Of several routes the one with the smallest (file, path) counts. ``points`` are read several times: pass a written table.
    """
    routes = points.where("kind = 'route' and path is not null")
    homes = symbols.select(F.col("name").alias("fn_name"), F.col("file").alias("home")).distinct()
    # of a name the smallest route, and the smallest of another file, are all that a home can get
    packed = F.struct("file", "path", F.coalesce("method", F.lit("")).alias("m"), "method", "middleware")
    first = routes.groupBy("fn_name").agg(F.min(packed).alias("a"))
    second = routes.join(first, "fn_name").where("file <> a.file").groupBy("fn_name").agg(F.min(packed).alias("b"))
    own = F.when(F.col("a.file") != F.col("home"), F.col("a")).otherwise(F.col("b"))
    best = homes.join(first, "fn_name").join(second, "fn_name", "left").select("fn_name", F.col("home").alias("file"), own.alias("r")).where("r is not null")
    joined = points.join(best, ["fn_name", "file"], "left")
    take = F.col("path").isNull() & F.col("r").isNotNull()
    mark = F.array_union("heuristics", F.array(F.lit("route_propagated")))
    return joined.select(
        "fn_name", "file", "line",
        F.when(take & (F.col("kind") == "leaf"), F.lit("route")).otherwise(F.col("kind")).alias("kind"),
        "framework",
        F.when(take, F.col("r.path")).otherwise(F.col("path")).alias("path"),
        F.when(take, F.col("r.method")).otherwise(F.col("method")).alias("method"),
        "confidence",
        F.when(take, mark).otherwise(F.col("heuristics")).alias("heuristics"),
        F.when(take & (F.size("r.middleware") > 0), F.col("r.middleware")).otherwise(F.col("middleware")).alias("middleware"),
    )


def remove_placeholders(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Entry points of a function that is defined somewhere, but not in their file, go."""
    homes = symbols.select(F.col("name").alias("fn_name"), "file").distinct()
    elsewhere = points.select("fn_name", "file").join(homes.select("fn_name").distinct(), "fn_name", "left_semi").join(homes, ["fn_name", "file"], "left_anti")
    return points.join(elsewhere, ["fn_name", "file"], "left_anti")


def detect(symbols: DataFrame, edges: DataFrame, hints: DataFrame, least: float = 0.5) -> DataFrame:
    """All entry points; those below ``least`` stay if any heuristic names them, as all do."""
    points = materialize(merge_entry_points(exported_leaves(symbols, edges), hints), "merged")  # read several times each
    points = remove_placeholders(materialize(propagate_routes(points, symbols), "propagated"), symbols)
    return points.where((F.col("confidence") >= least) | (F.size("heuristics") > 0))


def unique_rank(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
