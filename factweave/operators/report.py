"""The report: topology lines, entries grouped by access, one text line for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as S

WIDTH = 20


def padded(name: Column) -> Column:
    """Padded to WIDTH; longer names aren't cut."""
    return F.rpad(name, F.greatest(F.lit(WIDTH), F.length(name)), F.lit(" "))


def topology_lines(topology: DataFrame) -> DataFrame:
    """src, dst, line: both names padded, an arrow, and ``medium: key, key`` for each medium, two spaces between."""
    keys = topology.groupBy("src", "dst", "medium").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("keys"))
    parts = keys.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "medium", "keys"))), "  ").alias("parts"))
    return parts.select("src", "dst", F.concat(F.lit("  "), padded(F.col("src")), F.lit(" →  "), padded(F.col("dst")), F.lit(" "), F.col("parts")).alias("line"))


def file_refs(io: DataFrame) -> DataFrame:
    """start_fn, start_file, refs: sorted file:line of the events outside of tests and of the start's own file."""
    outside = io.where(~F.col("file").rlike("/test|/spec|_test\\.|_spec\\.") & (F.col("file") != F.col("start_file")))
    return outside.groupBy("start_fn", "start_file").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "file", "line"))), ", ").alias("refs"))


def io_columns(io: DataFrame) -> DataFrame:
    """start_fn, start_file and, for sql, redis and kafka, the sorted keys read and written; body and headers read."""
    keys = lambda cond, column: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col(column)))), ", ").alias
    is_ = lambda m, d: (F.col("medium") == m) & (F.col("direction") == d)
    aggregates = [keys(is_(m, d), "key_norm")(f"{m}_{d}") for m in ("sql", "redis", "kafka") for d in ("read", "write")]
    aggregates += [keys(is_("grpc", "read"), "key_raw")("body"), keys(is_("http_header", "read"), "key_norm")("headers")]
    return io.groupBy("start_fn", "start_file").agg(*aggregates)


def relative(file: Column, root: str) -> Column:
    """A path without the root before it and without leading slashes."""
    root = root.rstrip("/")
    return F.ltrim(F.when(file.startswith(root), F.substring(file, len(root) + 1, 1 << 30)).otherwise(file), F.lit("/"))


#: What a report of an entry groups by, in this order.
REPORTED = tuple((medium, direction) for medium in ("sql", "redis", "kafka") for direction in ("read", "write"))


def entry_io(io: DataFrame, root: str = "") -> DataFrame:
    """start_fn, start_file, lines: what an entry takes in, then its keys for each medium and direction with where they are.

    References are file:line below ``root``; those in tests and in the entry's own file are left out.
    """
    own, ref = relative(F.col("start_file"), root), F.concat_ws(":", relative(F.col("file"), root), "line")
    rows = io.select("*", F.when(~ref.rlike("/test|/spec|_test\\.|_spec\\.") & ~ref.startswith(own), ref).alias("ref"))
    name = "{}_{}_{}".format
    gathered = []
    for medium, direction in REPORTED:
        here = (F.col("medium") == medium) & (F.col("direction") == direction)
        gathered += [F.array_sort(F.collect_set(F.when(here, F.col(c)))).alias(name(medium, direction, c)) for c in ("key_norm", "ref")]
    body = F.when((F.col("medium") == "grpc") & (F.col("direction") == "read"), F.concat(F.lit("body{"), "key_raw", F.lit("}")))
    header = F.when((F.col("medium") == "http_header") & (F.col("direction") == "read"), F.col("key_raw"))
    found = rows.groupBy("start_fn", "start_file").agg(F.collect_set(body).alias("body"), F.array_sort(F.collect_set(header)).alias("headers"), *gathered)
    taken = F.array_sort(F.concat("body", F.when(F.size("headers") > 0, F.array(F.concat(F.lit("headers{"), F.array_join("headers", ", "), F.lit("}")))).otherwise(F.array())))
    lines = [F.when(F.size(taken) > 0, F.concat(F.lit("  in:   "), F.array_join(taken, ", ")))]
    for medium, direction in REPORTED:
        keys, refs = F.col(name(medium, direction, "key_norm")), F.col(name(medium, direction, "ref"))
        where = F.when(F.size(refs) > 0, F.concat(F.lit("  ["), F.array_join(refs, ", "), F.lit("]"))).otherwise(F.lit(""))
        lines.append(F.when(F.size(keys) > 0, F.concat(F.lit(f"  {medium}:  {direction}s "), F.array_join(keys, ", "), where)))
    return found.select("start_fn", "start_file", F.array_compact(F.array(*lines)).alias("lines"))


def report_lines(entries: DataFrame, io: DataFrame, topology: DataFrame, title: str = "project", date: str = "", files: DataFrame | None = None, root: str = "") -> DataFrame:
    """section, part, position, line: the whole report, sorted by the first three.

    Title and counts of ``files`` (file, language), the topology if there is any, then each
    service with the language of its first entry point (by file and line): public entries, those behind each
    kind of middleware, background ones, each by path and name. Empty lines end its parts. Paths
    are shown below ``root``.
    """
    numbered = lambda at: F.concat(at, F.lpad(F.col("n").cast("string"), 4, "0"))
    text = lambda *lines: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in lines])

    def block(rows: DataFrame, section, part: int, at, lines) -> DataFrame:
        """The lines of each row, in their order, at its place."""
        return rows.select(section.alias("section"), F.lit(part).alias("part"), at.alias("at"), F.posexplode(lines).alias("n", "line")).select("section", "part", numbered(F.col("at")).alias("position"), "line")

    none = F.lit("")
    known = files if files is not None else entries.select("file", S.language_of(F.col("file")).alias("language")).distinct()
    counts = known.agg(F.count(F.lit(1)).alias("n_files"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"))
    told = F.concat(F.lit(f"Generated: {date} | Files: "), F.col("n_files").cast("string"), F.lit(" | Languages: "), F.col("languages"))
    head = block(counts, none, 0, none, text(f"# Codemap — {title}", told, ""))
    links = topology_lines(topology)
    some = links.limit(1).agg(F.count(F.lit(1)).alias("some")).where("some > 0")
    first, last = block(some, none, 1, F.lit("0"), text("## Service Topology")), block(some, none, 1, F.lit("2"), text(""))
    middle = block(links, none, 1, F.concat_ws("\x01", F.lit("1"), "src", "dst"), F.array("line"))

    name = F.when(F.col("path").isNotNull() & F.col("method").isNotNull(), F.concat_ws(" ", "method", "path")).otherwise(F.col("fn_name"))
    bucket = S.auth_bucket(F.col("path"), F.col("middleware"))
    rank = F.when(bucket == "Public", F.lit("1")).when(bucket == "Background", F.lit("3")).otherwise(F.lit("2"))
    start = [F.col("start_fn").alias("fn_name"), F.col("start_file").alias("file")]
    rows = entries.join(entry_io(io, root).select(*start, "lines"), ["fn_name", "file"], "left")
    lines = F.concat(F.array(name, F.concat(F.lit("  file: "), F.concat_ws(":", relative(F.col("file"), root), "line"))), F.coalesce("lines", F.array().cast("array<string>")))
    at = F.concat_ws("\x01", rank, bucket, F.lit("1"), F.coalesce("path", none), "fn_name", "file", none)
    body = block(rows, F.col("service"), 2, at, lines)
    buckets = entries.select("service", rank.alias("rank"), bucket.alias("bucket")).distinct()
    top = block(buckets, F.col("service"), 2, F.concat_ws("\x01", "rank", "bucket", F.lit("0")), F.array(F.concat(F.lit("### "), "bucket")))
    end = block(buckets, F.col("service"), 2, F.concat_ws("\x01", "rank", "bucket", F.lit("2")), text(""))
    main = entries.groupBy("service").agg(F.min_by(S.language_of(F.col("file")), F.struct("file", F.coalesce("line", F.lit(0)), "fn_name")).alias("language"))
    services = block(main, F.col("service"), 2, F.lit("0"), text(F.concat(F.lit("## "), "service", F.lit(" ["), F.coalesce("language", F.lit("?")), F.lit("]")), ""))
    out = head
    for more in (first, middle, last, services, top, body, end):
        out = out.unionByName(more)
    return out
