"""Questions about the facts: who calls, what depends, who touches a key, how data flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import scalars as S
from factweave.operators.scopes import parts_of
from factweave.storage import materialize

#: Media that facts can have: fixed values.
KNOWN_MEDIA = ("redis", "kafka", "rabbitmq", "sqs", "pubsub", "sql", "http_header", "http_body", "http_out", "cookie", "env", "filesystem", "grpc", "websocket", "queue")
#: Below this an event is a candidate for review; below the other an entry point isn't traced.
REVIEW, TRACED = 0.7, 0.6
#: Names of functions that start a program, and media whose readers consume events: fixed values.
MAIN_NAMES, CONSUMED = ("main", "run", "start", "serve"), ("kafka", "rabbitmq", "sqs", "pubsub", "websocket")


def callers(adjacent: DataFrame) -> DataFrame:
    """fn, callers: how many calls lead to each function."""
    return adjacent.groupBy(F.col("dst_fn").alias("fn")).agg(F.count(F.lit(1)).alias("callers"))


def callees(adjacent: DataFrame) -> DataFrame:
    """fn, callees: the sorted names that each function calls, comma-joined."""
    return adjacent.groupBy(F.col("src_fn").alias("fn")).agg(F.array_join(F.array_sort(F.collect_list("dst_fn")), ",").alias("callees"))


def lookup(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The symbols with one of the names (column name)."""
    return symbols.join(names.select("name").distinct(), "name", "left_semi")


def search(symbols: DataFrame, pattern: str) -> DataFrame:
    """The symbols whose name matches a pattern."""
    return symbols.where(F.col("name").rlike(pattern))


def deps(edges: DataFrame) -> DataFrame:
    """file, module: what each file imports."""
    return edges.where("rel = 'imports' and dst_file is not null").select(F.col("src_file").alias("file"), F.col("dst_file").alias("module")).distinct()


def rdeps(edges: DataFrame) -> DataFrame:
    """module, files: how many files import each module."""
    return deps(edges).groupBy("module").agg(F.count(F.lit(1)).alias("files"))


def call_path(starts: DataFrame, goals: DataFrame, adjacent: DataFrame, max_depth: int = 6) -> DataFrame:
    """start_fn, start_file, fn, file, path: one shortest call path (names) from each start to each goal it reaches.

    Breadth first: a node keeps the smallest path, by names, of its first hop; so there is
    one row for each start and node, whatever the number of paths.
    """
    step = adjacent.select(F.col("src_fn").alias("fn"), F.col("src_file").alias("file"), "dst_fn", "dst_file")
    key = ["start_fn", "start_file", "fn", "file"]
    seen = front = materialize(starts.select(F.col("fn").alias("start_fn"), F.col("file").alias("start_file"), "fn", "file", F.array("fn").alias("path")).distinct(), "path")
    for _ in range(max_depth):
        new = front.join(step, ["fn", "file"]).select("start_fn", "start_file", F.col("dst_fn").alias("fn"), F.col("dst_file").alias("file"), F.array_append("path", F.col("dst_fn")).alias("path"))
        front = materialize(new.groupBy(*key).agg(F.min("path").alias("path")).join(seen.select(*key), key, "left_anti"), "path")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(goals.select("fn", "file").distinct(), ["fn", "file"], "left_semi").select(*key, "path")


def boundaries(events: DataFrame, medium: str | None = None) -> DataFrame:
    """fn_name, file, medium, events: how many events each function has, of one medium or all."""
    rows = events if medium is None else events.where(F.col("medium") == medium)
    return rows.groupBy("fn_name", "file", "medium").agg(F.count(F.lit(1)).alias("events"))


def cross(events: DataFrame) -> DataFrame:
    """key_norm, functions: keys that more than one function touches."""
    return events.groupBy("key_norm").agg(F.countDistinct("fn_name").alias("functions")).where("functions > 1")


def lowconf(events: DataFrame, below: float = REVIEW) -> DataFrame:
    """The events that want a review."""
    return events.where(F.col("prov_confidence") < below)


def stats(events: DataFrame) -> DataFrame:
    """medium, direction, events, keys."""
    return events.groupBy("medium", "direction").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("key_norm").alias("keys"))


def run_summary(files: DataFrame) -> DataFrame:
    """files, languages, lines of a table of sources."""
    lines = F.length("src") - F.length(F.replace("src", F.lit("\n"), F.lit(""))) + 1
    return files.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("language").alias("languages"), F.sum(lines).cast("long").alias("lines"))


def boundary_flows(events: DataFrame, least: float = 0.5) -> DataFrame:
    """writer, writer_file, reader, reader_file, medium, key_norm, confidence: who reads what another writes.

    Both events need the least confidence; the flow has the smaller one. Each side is
    reduced to one row for a function and key first.
    """
    sure = events.where(F.col("prov_confidence") >= least).groupBy("fn_name", "file", "medium", "key_norm", "direction").agg(F.max("prov_confidence").alias("c"))
    side = lambda direction, name: sure.where(F.col("direction") == direction).select(F.col("fn_name").alias(name), F.col("file").alias(f"{name}_file"), "medium", "key_norm", F.col("c").alias(f"c_{name}"))
    flows = side("write", "writer").join(side("read", "reader"), ["medium", "key_norm"])
    return flows.select("writer", "writer_file", "reader", "reader_file", "medium", "key_norm", F.least("c_writer", "c_reader").alias("confidence"))


def data_flow(events: DataFrame) -> DataFrame:
    """src_fn, src_file, dst_fn, dst_file, rel: reads, writes and data_flow as edges; a key is its own node."""
    key = F.concat_ws(":", "medium", "key_norm")
    none = F.lit(None).cast("string")
    touch = events.select("fn_name", "file", "direction", key.alias("key")).distinct()
    reads = touch.where("direction = 'read'").select(F.col("key").alias("src_fn"), none.alias("src_file"), F.col("fn_name").alias("dst_fn"), F.col("file").alias("dst_file"), F.lit("reads").alias("rel"))
    writes = touch.where("direction = 'write'").select(F.col("fn_name").alias("src_fn"), F.col("file").alias("src_file"), F.col("key").alias("dst_fn"), none.alias("dst_file"), F.lit("writes").alias("rel"))
    flows = boundary_flows(events).select(F.col("writer").alias("src_fn"), F.col("writer_file").alias("src_file"), F.col("reader").alias("dst_fn"), F.col("reader_file").alias("dst_file"), F.lit("data_flow").alias("rel"))
    return reads.unionByName(writes).unionByName(flows.distinct())


def carriers(events: DataFrame) -> DataFrame:
    """medium, key_norm, functions: the sorted functions that carry each key, comma-joined."""
    return events.groupBy("medium", "key_norm").agg(F.array_join(F.array_sort(F.collect_set("fn_name")), ",").alias("functions"))


def traces_touching(reached: DataFrame, events: DataFrame) -> DataFrame:
    """medium, key_norm, traces: how many entry points reach each key."""
    hit = reached.join(events.select(F.col("fn_name").alias("fn"), "file", "medium", "key_norm").distinct(), ["fn", "file"])
    return hit.select("start_fn", "start_file", "medium", "key_norm").distinct().groupBy("medium", "key_norm").agg(F.count(F.lit(1)).alias("traces"))


def skeleton(symbols: DataFrame, adjacent: DataFrame, events: DataFrame) -> DataFrame:
    """fn, file, position, text: a function's line, its events by line, then its calls; unsure facts end in ``?``."""
    head = symbols.where("kind = 'function'").select(F.col("name").alias("fn"), "file", F.lit("0").alias("position"), F.concat(F.lit("FN  "), "name", F.lit("  "), "file", F.lit(":"), F.col("line").cast("string")).alias("text"))
    unsure = F.when(F.col("prov_confidence") < REVIEW, F.lit(" ?")).otherwise(F.lit(""))
    body = events.select(
        F.col("fn_name").alias("fn"), "file", F.concat(F.lit("1"), F.lpad(F.coalesce("line", F.lit(0)).cast("string"), 9, "0")).alias("position"),
        F.concat(F.rpad(F.upper("direction"), 8, " "), "medium", F.lit('["'), "key_norm", F.lit('"]'), unsure).alias("text"),
    )
    calls = adjacent.select(F.col("src_fn").alias("fn"), F.col("src_file").alias("file"), F.concat(F.lit("2"), "dst_fn").alias("position"), F.concat(F.lit("CALL    "), "dst_fn", F.lit("()")).alias("text"))
    return head.unionByName(body).unionByName(calls).distinct()


def source_window(files: DataFrame, first: int, count: int, text: str = "src") -> Column:
    """``count`` lines of a text from line ``first``, joined by |."""
    return F.array_join(F.slice(F.split(text, "\n"), first, count), "|")


def baggage_names(values: DataFrame, owner: str, order: str) -> DataFrame:
    """Adds name: $v1, $v2, ... for the values of each owner, in order of first use."""
    return values.withColumn("name", F.concat(F.lit("$v"), F.dense_rank().over(Window.partitionBy(owner).orderBy(order))))


def nearest_vectors(vectors: DataFrame, asked: list[float], n: int = 10) -> DataFrame:
    """vec_id, score of the ``n`` vectors (vec_id, v) nearest by cosine: a top-k report."""
    q = F.array(*[F.lit(float(x)) for x in asked])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot(F.col("v"), q) / F.sqrt(dot(q, q)) / F.sqrt(dot(F.col("v"), F.col("v")))
    return vectors.select("vec_id", score.alias("s")).orderBy(F.desc("s"), "vec_id").limit(n).select("vec_id", F.round("s", 9).alias("score"))


def five_heuristics(points: DataFrame, events: DataFrame, symbols: DataFrame, least: float = TRACED) -> DataFrame:
    """fn_name, file, confidence, heuristics: detected entry points, consumers of events and functions that start programs.

    ``points`` has fn_name, file, confidence, heuristics (array). The largest confidence of
    a function counts; below ``least`` it isn't traced.
    """
    found = points.select("fn_name", "file", "confidence", F.explode("heuristics").alias("h"))
    consumers = events.where((F.col("direction") == "read") & F.col("medium").isin(*CONSUMED)).select("fn_name", "file", F.lit(0.90).alias("confidence"), F.lit("consumer").alias("h"))
    mains = symbols.where((F.col("kind") == "function") & F.col("name").isin(*MAIN_NAMES)).select(F.col("name").alias("fn_name"), "file", F.lit(0.80).alias("confidence"), F.lit("main_name").alias("h"))
    both = found.unionByName(consumers).unionByName(mains)
    return both.groupBy("fn_name", "file").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("h")).alias("heuristics")).where(F.col("confidence") >= least)


def to_annotate(functions: DataFrame, annotations: DataFrame, checkpoints: DataFrame, retry_failed: bool = True) -> DataFrame:
    """The functions (fn_name, file, source) without an annotation of their source's hash and not done, with source_hash."""
    hashed = functions.withColumn("source_hash", F.sha2("source", 256))
    settled = checkpoints.where(F.col("status").isin("done", "skipped", *([] if retry_failed else ["failed"])))
    return hashed.join(annotations, "source_hash", "left_anti").join(settled.select(F.col("key").alias("source_hash")), "source_hash", "left_anti")


def checkpoint_statuses(old: DataFrame, new: DataFrame) -> DataFrame:
    """step, key, status: the last status of each step and key; ``new`` replaces ``old``."""
    both = old.select("step", "key", "status", F.lit(0).alias("__at")).unionByName(new.select("step", "key", "status", F.lit(1).alias("__at")))
    return both.groupBy("step", "key").agg(F.max_by("status", "__at").alias("status"))


def validated(annotations: DataFrame) -> DataFrame:
    """Annotations (fn_name, raw: JSON) checked: fn_name, ok, problem, purpose, value_names, missed.

    Text that isn't JSON, or has no purpose, fails. A purpose of more than 30 words is cut to
    30. Value names that don't begin with the diamond and a lower-case word are dropped, as
    are missed boundaries of unknown media.
    """
    shape = "purpose string, value_names array<string>, missed_boundaries array<struct<medium:string,key:string,line:bigint>>"
    read = annotations.withColumn("a", F.from_json("raw", shape, {"mode": "PERMISSIVE"}))
    is_json = F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")
    problem = F.when(~is_json, F.lit("unparseable JSON")).when(F.col("a.purpose").isNull(), F.lit("missing field: purpose"))
    purpose = F.array_join(F.slice(F.split(F.trim("a.purpose"), r"\s+"), 1, 30), " ")
    names = F.filter("a.value_names", lambda n: n.rlike("^◆[a-z][a-z0-9_]+$"))
    missed = F.filter("a.missed_boundaries", lambda m: m["medium"].isin(*KNOWN_MEDIA))
    ok = problem.isNull()
    return read.select("fn_name", ok.alias("ok"), problem.alias("problem"), F.when(ok, purpose).alias("purpose"), F.when(ok, names).alias("value_names"), F.when(ok, missed).alias("missed"))


def budgeted(paths: DataFrame, budget: int) -> DataFrame:
    """The paths (start_fn, start_file, path, depth) of each start within a budget of spans, and truncated: how many more there are."""
    order = Window.partitionBy("start_fn", "start_file").orderBy("depth", "path")
    n = paths.withColumn("__n", F.row_number().over(order)).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy("start_fn", "start_file")))
    return n.where(F.col("__n") <= budget).withColumn("truncated", F.greatest(F.col("__all") - budget, F.lit(0))).drop("__n", "__all")


def serialize(paths: DataFrame, form: str = "text") -> DataFrame:
    """start_fn, start_file, position, text: spans as indented text, as one arrow line each (compact), or as JSON (otlp)."""
    name = lambda node: F.substring_index(node, "@", 1)
    leaf, parent = F.element_at("path", -1), F.try_element_at("path", F.lit(-2))
    if form == "compact":
        text = F.when(F.size("path") > 1, F.concat_ws(" → ", name(parent), name(leaf))).otherwise(name(leaf))
    elif form == "otlp":
        text = F.to_json(F.struct(F.sha2(F.array_join("path", "/"), 256).substr(1, 16).alias("spanId"), F.when(parent.isNotNull(), F.sha2(F.array_join(F.slice("path", 1, F.size("path") - 1), "/"), 256).substr(1, 16)).alias("parentSpanId"), name(leaf).alias("name")))
    else:
        text = F.concat(F.repeat(F.lit("  "), (F.size("path") - 1).cast("int")), name(leaf))
    return paths.select("start_fn", "start_file", F.array_join("path", "/").alias("position"), text.alias("text"))


def trace_stats(reached: DataFrame, events: DataFrame) -> DataFrame:
    """start_fn, start_file, span_count, media, min_confidence of each trace; no events give an empty list and null."""
    spans = reached.groupBy("start_fn", "start_file").agg(F.count(F.lit(1)).alias("span_count"))
    touched = events.groupBy(F.col("fn_name").alias("fn"), "file", "medium").agg(F.min("prov_confidence").alias("c"))
    hit = reached.join(touched, ["fn", "file"]).groupBy("start_fn", "start_file").agg(F.array_join(F.array_sort(F.collect_set("medium")), ",").alias("media"), F.min("c").alias("min_confidence"))
    return spans.join(hit, ["start_fn", "start_file"], "left").withColumn("media", F.coalesce("media", F.lit("")))


def changed_roots(reached: DataFrame, changed: DataFrame) -> DataFrame:
    """start_fn, start_file: the traces to build again, as they reach a changed file (column file)."""
    return reached.join(changed.select("file").distinct(), "file", "left_semi").select("start_fn", "start_file").distinct()


def workspace_roots(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """file, root: the nearest folder above each file (file, language) with a manifest of its language.

    ``manifests`` has folder and name. Only the folders above a file are looked up.
    """
    from factweave import rules as R

    wanted = F.create_map(*[x for k, v in R.MANIFESTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    rows = files.select("file", "language", F.split("file", "/").alias("parts")).where("size(parts) > 1")
    rows = rows.select("file", F.explode(F.try_element_at(wanted, F.col("language"))).alias("name"), "parts").select("file", "name", F.explode(above).alias("folder"))
    return rows.join(manifests.select("folder", "name").distinct(), ["folder", "name"]).groupBy("file").agg(F.max_by("folder", F.length("folder")).alias("root"))


def resolve_edges(edges: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Calls without a target file get the one that ``resolutions`` (src_file, line, dst_symbol, dst_file) states."""
    last = resolutions.groupBy("src_file", "line", "dst_symbol").agg(F.max("dst_file").alias("__file"))
    joined = edges.join(last, ["src_file", "line", "dst_symbol"], "left")
    open_ = (F.col("rel") == "calls") & F.col("dst_file").isNull()
    return joined.withColumn("dst_file", F.when(open_, F.col("__file")).otherwise(F.col("dst_file"))).select(*edges.columns)


def resolution_requests(edges: DataFrame, files: DataFrame) -> DataFrame:
    """src_file, line, dst_symbol, language, column: where a definition of each open call can be asked for.

    Calls meet their own line, not the whole text, so this is linear in files of any length. Both are dealt by
    line to tasks of bounded text: Spark takes a table of texts for as small as its keys and would broadcast it.
    """
    parts = parts_of(files)
    key = ["src_file", "line"]
    open_ = edges.where("rel = 'calls' and dst_file is null and line is not null").select(*key, "dst_symbol").distinct()
    lines = files.select(F.col("file").alias("src_file"), F.posexplode(F.split("src", "\n")).alias("at", "text")).select("src_file", (F.col("at") + 1).cast("long").alias("line"), "text")
    found = open_.repartition(parts, *key).join(lines.repartition(parts, *key).hint("merge"), key)
    at = S.symbol_column(F.col("text"), F.col("dst_symbol"))
    return found.select(*key, "dst_symbol", S.server_language(F.col("src_file")).alias("language"), at.alias("column")).where("column is not null")
