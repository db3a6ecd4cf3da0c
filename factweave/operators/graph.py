"""The call graph: resolution of callees, bounded reachability, what an entry point reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.storage import materialize

NODE = ("fn", "file")


def adjacency_direct(edges: DataFrame) -> DataFrame:
    """Calls whose target file is known."""
    calls = edges.where("rel = 'calls' and src_symbol is not null and dst_symbol is not null and dst_file is not null")
    return calls.select(F.col("src_symbol").alias("src_fn"), "src_file", F.col("dst_symbol").alias("dst_fn"), "dst_file").distinct()


def adjacency_unique_target(edges: DataFrame, symbols: DataFrame, same_file: bool = False) -> DataFrame:
    """Calls of a name that exactly one file defines, the caller's own file left out.

    With ``same_file`` a definition in the caller's file wins over the others.
    """
    calls = edges.where("rel = 'calls' and src_symbol is not null and dst_symbol is not null and dst_file is null")
    calls = calls.select(F.col("src_symbol").alias("src_fn"), "src_file", F.col("dst_symbol").alias("dst_fn")).distinct()
    homes = symbols.where("kind = 'function'").select(F.col("name").alias("dst_fn"), F.col("file").alias("dst_file")).distinct()
    # at most two files of a name other than the caller's own decide; names are grouped once, not for each call
    many = homes.groupBy("dst_fn").agg(F.count(F.lit(1)).alias("n"), F.min("dst_file").alias("low"), F.max("dst_file").alias("high"))
    own = homes.select("dst_fn", F.col("dst_file").alias("src_file"), F.lit(True).alias("own"))
    rows = calls.join(many, "dst_fn").join(own, ["dst_fn", "src_file"], "left")
    others = F.col("n") - F.coalesce(F.col("own").cast("int"), F.lit(0))
    other = F.when(F.col("low") == F.col("src_file"), F.col("high")).otherwise(F.col("low"))
    target = F.when(others == 1, other)
    if same_file:
        target = F.when(F.col("own"), F.col("src_file")).otherwise(target)
    return rows.withColumn("dst_file", target).where("dst_file is not null").select("src_fn", "src_file", "dst_fn", "dst_file")


def adjacency(edges: DataFrame, symbols: DataFrame, same_file: bool = False) -> DataFrame:
    return adjacency_direct(edges).unionByName(adjacency_unique_target(edges, symbols, same_file)).distinct()


def ambiguous_calls(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unresolved calls of a name with more than one definition row."""
    several = symbols.groupBy(F.col("name").alias("dst_symbol")).agg(F.count(F.lit(1)).alias("definitions")).where("definitions > 1")
    return edges.where("rel = 'calls' and dst_file is null").join(several, "dst_symbol")


def reach(starts: DataFrame, adjacent: DataFrame, max_depth: int = 6) -> DataFrame:
    """start_fn, start_file, fn, file, depth: every node within ``max_depth`` calls, at its smallest depth.

    Breadth first, all starts at once; each hop's frontier is written, so the plan
    of a hop never holds the hops before it.
    """
    step = adjacent.select(F.col("src_fn").alias("fn"), F.col("src_file").alias("file"), "dst_fn", "dst_file")
    key = ["start_fn", "start_file", "fn", "file"]
    frontier = starts.select(F.col("fn").alias("start_fn"), F.col("file").alias("start_file"), "fn", "file").distinct().withColumn("depth", F.lit(0))
    frontier = seen = materialize(frontier, "reach")
    for depth in range(1, max_depth + 1):
        new = frontier.join(step, ["fn", "file"]).select("start_fn", "start_file", F.col("dst_fn").alias("fn"), F.col("dst_file").alias("file")).distinct()
        frontier = materialize(new.join(seen.select(*key), key, "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(starts: DataFrame, adjacent: DataFrame, max_depth: int = 3) -> DataFrame:
    """start_fn, start_file, path (array of fn@file), depth: simple call paths; no node twice in one."""
    node = lambda fn, file: F.concat_ws("@", fn, file)
    step = adjacent.select(F.col("src_fn").alias("fn"), F.col("src_file").alias("file"), "dst_fn", "dst_file")
    rows = starts.select(F.col("fn").alias("start_fn"), F.col("file").alias("start_file"), "fn", "file", F.array(node("fn", "file")).alias("path"))
    out = rows
    for _ in range(max_depth):
        rows = rows.join(step, ["fn", "file"]).where(~F.array_contains("path", node(F.col("dst_fn"), F.col("dst_file")))).select(
            "start_fn", "start_file", F.col("dst_fn").alias("fn"), F.col("dst_file").alias("file"), F.array_append("path", node("dst_fn", "dst_file")).alias("path")
        )
        rows = materialize(rows, "paths")
        out = out.unionByName(rows)
    return out.select("start_fn", "start_file", "path", (F.size("path") - 1).alias("depth"))


#: How spans of a trace are ordered below their parent.
STEP_KINDS = ("call", "data_flow", "boundary_flow")


def trace_steps(adjacent: DataFrame, flows: DataFrame) -> DataFrame:
    """fn, file, dst_fn, dst_file, kind: calls, and flows (writer, writer_file, reader, reader_file, medium) within a file or over a boundary."""
    calls = adjacent.select(F.col("src_fn").alias("fn"), F.col("src_file").alias("file"), "dst_fn", "dst_file", F.lit("call").alias("kind"))
    kind = F.when(F.col("writer_file") == F.col("reader_file"), F.lit("data_flow")).otherwise(F.lit("boundary_flow"))
    moved = flows.select(F.col("writer").alias("fn"), F.col("writer_file").alias("file"), F.col("reader").alias("dst_fn"), F.col("reader_file").alias("dst_file"), kind.alias("kind"))
    return calls.unionByName(moved).distinct()


def traces(starts: DataFrame, steps: DataFrame, budget: int = 500, max_depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """Spans (start_fn, start_file, depth, position, path, kind, again) and cuts (start_fn, start_file, truncated).

    Calls and flows are followed together, breadth first. A start has at most ``budget`` spans besides itself: those of
    earlier hops first, then by their parent's position, kind and name; ``truncated`` counts the steps
    of followed spans that were left out. A span that is on its own path already is told (again) and not
    followed. Out-degrees say before each hop's join which steps fit, so the join itself makes no more
    than budget rows for a start, and of a hub no more than ``budget`` steps are read.
    """
    key = ["start_fn", "start_file"]
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(STEP_KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    degree = materialize(steps.groupBy("fn", "file").agg(F.count(F.lit(1)).alias("degree")), "trace-degrees")
    number = F.row_number().over(Window.partitionBy("fn", "file").orderBy(rank, "dst_fn", "dst_file"))
    ranked = materialize(steps.withColumn("n", number).where(F.col("n") <= budget), "trace-steps")
    node = lambda fn, file: F.concat_ws("@", fn, file)
    none = F.lit(None).cast("string")
    rows = starts.select(F.col("fn").alias("start_fn"), F.col("file").alias("start_file"), "fn", "file").distinct().select(
        *key, "fn", "file", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("position"), F.array(node("fn", "file")).alias("path"), none.alias("kind"), F.lit(False).alias("again"), F.lit(budget).cast("long").alias("left")
    )
    rows = spans = materialize(rows, "trace")
    cuts = None
    by_start = Window.partitionBy(*key)
    for depth in range(1, max_depth + 1):
        offered = rows.where("not again").join(degree, ["fn", "file"]).withColumn("total", F.sum("degree").over(by_start))
        earlier = F.coalesce(F.sum("degree").over(by_start.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offered = materialize(offered.withColumn("earlier", earlier), "trace-offered")
        cut = offered.groupBy(*key).agg(F.greatest(F.first("total") - F.first("left"), F.lit(0)).alias("truncated"))
        cuts = cut if cuts is None else cuts.unionByName(cut)
        fit = offered.where(F.col("earlier") < F.col("left")).select(*key, "fn", "file", "path", "earlier", "left", "total")
        taken = fit.join(ranked.withColumnRenamed("kind", "next_kind"), ["fn", "file"]).where(F.col("earlier") + F.col("n") <= F.col("left"))
        made = taken.select(
            *key, F.col("dst_fn").alias("fn"), F.col("dst_file").alias("file"), F.lit(depth).alias("depth"), (F.col("earlier") + F.col("n")).alias("position"),
            F.array_append("path", node("dst_fn", "dst_file")).alias("path"), F.col("next_kind").alias("kind"), F.array_contains("path", node(F.col("dst_fn"), F.col("dst_file"))).alias("again"),
            F.greatest(F.col("left") - F.col("total"), F.lit(0)).alias("left"),
        )
        rows = materialize(made, "trace")
        if rows.isEmpty():
            break
        spans = spans.unionByName(rows)
    cuts = starts.select(F.col("fn").alias("start_fn"), F.col("file").alias("start_file")).distinct().join(cuts.groupBy(*key).agg(F.sum("truncated").alias("truncated")), key, "left")
    return spans.select(*key, "depth", "position", "path", "kind", "again"), cuts.select(*key, F.coalesce("truncated", F.lit(0)).cast("long").alias("truncated"))


def reached_events(reached: DataFrame, events: DataFrame, least: float = 0.5) -> DataFrame:
    """Events of the nodes that each start reaches, the first for each (medium, key, direction)."""
    rows = reached.join(events.where(F.col("prov_confidence") >= least).withColumnRenamed("fn_name", "fn"), ["fn", "file"])
    order = Window.partitionBy("start_fn", "start_file", "medium", "key_norm", "direction").orderBy("depth", "file", "line", "fn", "ord")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
