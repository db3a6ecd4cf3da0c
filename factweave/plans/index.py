"""From a source tree to all facts and the report."""

from __future__ import annotations

import argparse
import datetime
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import attribute, entrypoints, explore, extract, graph, report, scopes, topology
from factweave.rules import SYMBOL
from factweave.sources.files import read_tree, save_snapshot, snapshot_status, table_exists, write_report
from factweave.storage import materialize, small_tasks


@dataclass(frozen=True)
class Config:
    """max_depth: calls followed from an entry point. compat: first table of a query only, no calls
    within a file, and a fact belongs to the last function above it, not to the innermost one around it."""

    max_depth: int = 6
    min_confidence: float = 0.5
    compat: bool = False


def index(files: DataFrame, config: Config = Config(), verdicts: DataFrame | None = None, resolutions: DataFrame | None = None, title: str = "project", date: str = "", root: str = "") -> dict[str, DataFrame]:
    """All tables of ``files`` (file, language, src): facts, entry points, what they reach, topology, report.

    ``verdicts`` change the confidence of events, ``resolutions`` (src_file, line,
    dst_symbol, dst_file) give open calls their target.
    """
    files = files.select("file", "language", "src")
    parts = scopes.parts_of(files)
    with small_tasks(files.sparkSession, parts):
        # comments and strings are told apart once for all extractors
        return _index(materialize(extract.lexed(files), "lexed"), parts, config, verdicts, resolutions, title, date, root)


def _index(files: DataFrame, parts: int, config: Config, verdicts: DataFrame | None, resolutions: DataFrame | None, title: str, date: str, root: str) -> dict[str, DataFrame]:
    symbols = materialize(scopes.scopes(files, parts).withColumns({"prov_source": F.lit("lexical"), "prov_confidence": F.lit(SYMBOL)}), "symbols")
    found = extract.edges(files)
    edges = attribute.attribute_edges(found, symbols) if config.compat else scopes.enclosing_edges(found, symbols, parts)
    edges = materialize(edges if resolutions is None else explore.resolve_edges(edges, resolutions), "edges")
    events = attribute.merge_first_wins(extract.boundary_events(files, compat=config.compat).repartition(parts, "file"), compat=config.compat)
    events = (attribute.attribute_events(events, symbols) if config.compat else scopes.enclosing(events, symbols, parts=parts)).where("medium <> 'http_body'")
    if verdicts is not None:
        events = attribute.overlay_verdicts(events, verdicts)
    events = materialize(events, "events")
    points = materialize(entrypoints.detect(symbols, edges, extract.entry_hints(files), config.min_confidence), "points")
    near = materialize(graph.adjacency(edges, symbols, same_file=not config.compat), "adjacency")
    reached = graph.reach(points.select(F.col("fn_name").alias("fn"), "file"), near, config.max_depth)
    io = materialize(graph.reached_events(reached, events, config.min_confidence), "io")
    homes = materialize(topology.services(files), "services")
    entries = materialize(topology.service_entries(points, io, homes), "entries")
    real = entries.select("service").distinct()
    sure = attribute.confidence_filter(events, config.min_confidence)
    resolved = topology.resolve_paths(sure.where("medium = 'http_out'").select(F.col("key_raw").alias("path")), topology.route_index(entries), real)
    has_transport = bool(extract.transport(files).first()["has_transport"])
    links = topology.topology_http(sure, homes, resolved).unionByName(topology.topology_keys(sure, symbols, homes, real, has_transport))
    return {
        "symbols": symbols, "edges": edges, "events": events, "entry_points": points, "adjacency": near, "reached": reached, "io": io,
        "services": homes, "entries": entries, "topology": links.distinct(), "meta": extract.file_meta_counts(files),
        "report": report.report_lines(entries, io, links.distinct(), title, date, files, root), "summary": explore.run_summary(files),
    }


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="Index a source tree and write its report.")
    args.add_argument("root")
    args.add_argument("--out", default="codemap.md")
    args.add_argument("--depth", type=int, default=6)
    args.add_argument("--min-confidence", type=float, default=0.5)
    args.add_argument("--title", default="")
    args.add_argument("--date", default=datetime.date.today().isoformat())
    args.add_argument("--snapshot", default="", help="folder of the snapshot that files are held against; a new one replaces it")
    args.add_argument("--verdicts", default="", help="Parquet of verdicts on events")
    args.add_argument("--resolutions", default="", help="Parquet of resolved definitions")
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName("factweave").getOrCreate()
    tree = materialize(read_tree(spark, a.root), "tree")
    if a.snapshot:
        old = spark.read.parquet(a.snapshot) if table_exists(spark, a.snapshot) else tree.select("file", "sha256").limit(0)
        print({r["status"]: r["n"] for r in snapshot_status(tree, materialize(old, "snapshot")).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()})
    given = lambda path: spark.read.parquet(path) if path else None
    tables = index(tree, Config(a.depth, a.min_confidence), given(a.verdicts), given(a.resolutions), a.title or Path(a.root).resolve().name, a.date, a.root)
    write_report(tables["report"], a.out)
    if a.snapshot:  # last: a run that fails leaves files as they were seen before
        save_snapshot(tree, a.snapshot)
    print(tables["summary"].first().asDict() | {k: tables[k].count() for k in ("symbols", "edges", "events", "entry_points", "topology")} | {"services": tables["entries"].select("service").distinct().count()})


if __name__ == "__main__":
    main()
