"""Facts of source files: symbols, edges, boundary events, entry-point hints, counts.

Input is ``files`` (file, language, src). Each extractor is one narrow projection and
an explode: patterns run where the file is read, nothing is shuffled.
"""

from __future__ import annotations

import functools
from functools import reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave import rules as R
from factweave.functions import lexer as L
from factweave.functions import scalars as S


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def let(value: Column, of) -> Column:
    """``of(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


#: Characters that are put before and after matches, and what stands for them where a source has them itself.
_BEGIN, _END, _OTHER = "\x01", "\x02", "\x03"


def has_marks(src: Column) -> Column:
    return F.contains(src, F.lit(_BEGIN)) | F.contains(src, F.lit(_END))


def matches(src: Column, pattern: str, make, odd: Column | None = None) -> Column:
    """Array of ``make(text, line)`` for the non-overlapping matches of a pattern, in one scan and linear time.

    Every match is marked where it begins and ends; the marks of each line say which lines they are on. Of a source
    with one match, as most have, only what is before it counts. ``odd``: ``has_marks`` of the source, where it is known.
    """
    odd = has_marks(src) if odd is None else odd
    plain = F.when(odd, F.replace(F.replace(src, F.lit(_BEGIN), F.lit(_OTHER)), F.lit(_END), F.lit(_OTHER))).otherwise(src)
    begins = lambda text: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(_BEGIN), F.lit("")))

    def found(marked: Column, pieces: Column) -> Column:
        shown = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda piece: F.substring_index(piece, _END, 1))
        texts = F.when(odd, F.regexp_extract_all(src, F.lit(pattern), 0)).otherwise(shown)
        every = F.flatten(F.transform(F.split(marked, "\n"), lambda text, i: F.array_repeat((i + 1).cast("long"), begins(text))))
        lines = F.when(F.size(pieces) == 2, F.array((newlines(F.get(pieces, F.lit(0))) + 1).cast("long"))).otherwise(every)
        return F.when(F.size(pieces) > 1, F.zip_with(texts, lines, make)).otherwise(F.array())

    return let(F.regexp_replace(plain, pattern, f"{_BEGIN}$0{_END}"), lambda marked: let(F.split(marked, _BEGIN), lambda pieces: found(marked, pieces)))


def lexed(files: DataFrame) -> DataFrame:
    """``files`` with code (comments blanked) and bare (strings, too); extractors that are given them don't lex again."""
    return files.withColumn("code", L.code()).withColumn("bare", L.bare())


def _coded(files: DataFrame) -> DataFrame:
    return files if "code" in files.columns else files.withColumn("code", L.code())


def _guarded(languages, rows: Column) -> Column:
    return F.when(F.col("language").isin(*languages), rows).otherwise(F.array())


def _group(text: Column, pattern: str, groups) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups])


def direction_of(rule: R.Rule, text: Column, key: Column) -> Column:
    """Read or write of one match of a rule."""
    if rule.direction in ("read", "write"):
        return F.lit(rule.direction)
    if rule.direction == "verb":
        return S.sql_verb(key)
    if rule.direction == "header":
        return F.lit("read")
    reads = {
        "select": F.upper(key).contains("SELECT"),
        "find": F.regexp_extract(text, rule.pattern, 2).rlike("^(find|count)"),
        "manager": F.regexp_extract(text, rule.pattern, 2).isin("filter", "get", "all", "first", "last"),
        "session": F.regexp_extract(text, rule.pattern, 1) == "query",
        "file": F.regexp_extract(text, rule.pattern, 1).contains("read"),
    }[rule.direction]
    return F.when(reads, F.lit("read")).otherwise(F.lit("write"))


def arguments(body: Column) -> Column:
    """Array of the trimmed arguments of a call, from the text after its opening bracket; brackets and strings nest.

    Null if the call's end isn't in the text. A comma before the end adds no argument.
    """
    state = F.struct(F.lit(1).alias("depth"), F.lit("").alias("own"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, piece: Column) -> Column:
        opens, closes = ((piece == a) | (piece == b) | (piece == c) for a, b, c in ("([{", ")]}"))
        depth = s["depth"] + F.when(opens, F.lit(1)).when(closes, F.lit(-1)).otherwise(F.lit(0))
        cut = (depth == 0) | ((depth == 1) & (piece == ","))
        made = F.struct(depth.alias("depth"), F.when(cut, F.lit("")).otherwise(F.concat(s["own"], piece)).alias("own"), F.when(cut, F.array_append(s["done"], F.trim(s["own"]))).otherwise(s["done"]).alias("done"))
        return F.when(s["depth"] == 0, s).otherwise(made)

    # most calls end early: only what is before the end is taken apart
    ended = F.coalesce(F.nullif(F.regexp_extract(body, R.CALL_END, 0), F.lit("")), body)
    pieces = F.regexp_extract_all(ended, F.lit(R.ARGUMENT_PIECES), 0)
    return F.aggregate(pieces, state, step, lambda s: F.when(s["depth"] == 0, F.filter(s["done"], lambda a: a != "")))


def call_sites(code: Column, rules, odd: Column | None = None) -> Column:
    """Array of (head, arguments, line) of the calls of any of the rules' methods; one scan for all rules."""
    methods = dict.fromkeys(m for r in rules for m in r.methods)
    head = R.CALL_SITE.replace("{}", "|".join(methods))
    bodies = F.regexp_extract_all(code, F.lit(rf"{head}(?=((?s:.{{0,{R.CALL_SPAN}}}+)))"), 1)
    heads = matches(code, head, lambda text, line: F.struct(text.alias("head"), line.alias("line")), odd)
    return F.zip_with(heads, bodies, lambda h, b: F.struct(h["head"].alias("head"), arguments(b).alias("args"), h["line"].alias("line")))


def site_key(rule: R.Rule, site: Column) -> Column:
    """The key that a rule finds in a call; null if it isn't the rule's."""
    args = site["args"]
    quote = "['\"]" if rule.languages == R.JS else R.Q  # a template isn't a plain string
    if rule.strip:
        key = F.element_at(args, -1)
    elif rule.last:
        key = F.nullif(F.regexp_extract(F.element_at(args, -1), rf"\A{quote}({R.N}+){quote}\z", 1), F.lit(""))
    else:
        key = F.nullif(F.regexp_extract(F.element_at(args, 1), rf"\A{rule.prefix}{quote}({R.N}+){quote}", 1), F.lit(""))
    of = site["head"].rlike(rf"(?:{rule.receivers}){rule.dot}(?:{'|'.join(rule.methods)})\s*\(\z")
    return F.when(of & (F.size(args) >= rule.least), key)


def boundary_events(files: DataFrame, rules=None, compat: bool = False) -> DataFrame:
    """One row for each event: file, line, fn_name, direction, medium, key_raw, key_norm, prov_source, prov_confidence, rule, ord, raw_context.

    Comments give none. A query gives one event for each table in it; with ``compat`` a call
    rule's query gives its primary table alone. ``ord`` orders the events of a file: call rules before patterns,
    then by rule and line. ``raw_context`` is the line's text.
    """
    coded = _coded(files.select("file", "language", "src", *[c for c in files.columns if c == "code"])).withColumn("odd", has_marks(F.col("code")))
    found = _events_of(tuple(rules or (*R.CALL_RULES, *R.EVENT_RULES)), SparkContext._active_spark_context)
    # each event takes its line along; the text itself isn't copied to them
    told = let(F.split("src", "\n"), lambda texts: F.transform(found, lambda e: F.struct(e.alias("e"), F.get(texts, e["line"].cast("int") - 1).alias("raw_context"))))
    rows = coded.select("file", "language", F.explode(told).alias("x")).select("file", "language", "x.e.*", "x.raw_context").where("key_raw is not null")
    every = S.sql_tables(F.col("key_raw"))
    if compat:
        every = F.when(F.col("prov_source") == "lexical", F.array_compact(F.array(S.sql_primary_table(F.col("key_raw"))))).otherwise(every)
    tables = F.when(F.col("is_sql"), every).otherwise(F.array("key_raw"))
    rows = rows.withColumn("key", F.explode(tables)).withColumn("key_norm", S.normalise_key(F.col("key")))
    return rows.select("file", "language", "line", F.lit("<module>").alias("fn_name"), "direction", "medium", "key_raw", "key_norm", "prov_source", "prov_confidence", "rule", "ord", F.trim("raw_context").alias("raw_context"))


@functools.lru_cache(maxsize=64)
def _events_of(rules: tuple[R.Rule, ...], context) -> Column:
    """Array of all events of a file (columns language, code, odd); built once for a session, as it is a large expression."""
    rules = [(i, r) for i, r in enumerate(rules) if r.enabled]
    code, odd = F.col("code"), F.col("odd")

    def event(rule: R.Rule, number: int, text: Column, line: Column, key: Column) -> Column:
        key = S.strip_literal(key) if rule.strip else key
        key = F.when(~key.isin(*rule.never), key) if rule.never else key
        return F.struct(
            line.alias("line"),
            direction_of(rule, text, key).alias("direction"),
            (S.header_medium(key) if rule.direction == "header" else F.lit(rule.medium)).alias("medium"),
            (S.outgoing_path(key) if rule.medium == "http_out" else key).alias("key_raw"),
            F.lit("lexical" if rule.confidence > R.PATTERN else "regex").alias("prov_source"),
            F.lit(rule.confidence).alias("prov_confidence"),
            F.lit(rule.name).alias("rule"),
            F.lit(number).alias("ord"),
            F.lit(rule.medium == "sql" and rule.direction in ("select", "verb")).alias("is_sql"),
        )

    def of_sites(language: str) -> Column | None:
        own = [(i, r) for i, r in rules if r.methods and language in r.languages]
        if not own:
            return None
        found = lambda site: F.transform(
            F.array(*[F.struct(F.lit(i).alias("i"), site_key(r, site).alias("key")) for i, r in own]), lambda x: F.struct(x["i"].alias("i"), x["key"].alias("key"), site["head"].alias("head"), site["line"].alias("line"))
        )
        hits = F.filter(F.flatten(F.transform(call_sites(code, [r for _, r in own], odd), found)), lambda x: x["key"].isNotNull())

        def made(x: Column) -> Column:
            out = None
            for i, r in own:
                out = (F if out is None else out).when(x["i"] == i, event(r, i, x["head"], x["line"], x["key"]))
            return out

        return F.transform(hits, made)

    def of_pattern(rule: R.Rule, number: int) -> Column:
        found = matches(code, rule.pattern, lambda text, line: event(rule, number, text, line, _group(text, rule.pattern, rule.key)), odd)
        return F.when(reduce(or_, [F.contains(code, F.lit(n)) for n in rule.needs]), found).otherwise(F.array()) if rule.needs else found

    # rules of the same languages have one guard: a list is searched slowly outside of generated code
    parts: dict[tuple[str, ...], list[Column]] = {}
    for i, r in rules:
        if not r.methods:
            parts.setdefault(r.languages, []).append(of_pattern(r, i))
    for language in R.ALL:
        if (sites := of_sites(language)) is not None:
            parts.setdefault((language,), []).append(sites)
    return F.concat(*[_guarded(languages, F.concat(*found)) for languages, found in parts.items()])


def _lines(files: DataFrame, text: Column) -> DataFrame:
    return files.select("file", "language", F.posexplode(F.split(text, "\n")).alias("at", "text")).select("file", "language", (F.col("at") + 1).cast("long").alias("line"), "text")


def code_lines(files: DataFrame) -> DataFrame:
    """file, language, line, text of every line, comments blanked."""
    return _lines(files, F.col("code") if "code" in files.columns else L.code())


def bare_lines(files: DataFrame) -> DataFrame:
    """file, language, line, text of every line, comments and strings blanked."""
    if "bare" in files.columns:
        return _lines(files, F.col("bare"))
    return _lines(_coded(files).select("file", "language", "code"), L.bare())


@functools.lru_cache(maxsize=4)
def _defined(context) -> Column:
    """Struct of name, kind and is_exported that the first matching rule gives for a line; null where none does."""

    def row(rule) -> Column:
        _, kind, pattern, export = rule
        name = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
        exported = {
            "export": lambda n: F.col("text").rlike(r"^\s*export\b"),
            "public": lambda n: ~n.startswith("_"),
            "pub": lambda n: F.col("text").rlike(r"^\s*(?:#\[[^\]]*\]\s*)*pub\b"),
            "upper": lambda n: n.rlike("^[A-Z]"),
            "always": lambda n: F.lit(True),
        }[export]
        made = lambda n: F.when(n.isNotNull() & ~n.isin(*R.NOT_DEFINED), F.named_struct(F.lit("name"), n, F.lit("kind"), F.lit(kind), F.lit("is_exported"), exported(n)))
        return let(name, made)  # a name is found once

    found = None
    for language in R.ALL:
        first = F.coalesce(*[row(r) for r in R.SYMBOL_RULES if r[0] == language])
        found = (F if found is None else found).when(F.col("language") == language, first)
    return found


def with_symbols(lines: DataFrame) -> DataFrame:
    """``bare_lines`` with s (name, kind, is_exported; null without a symbol), at (marks of its line before it), one_line (it has no block)."""
    ruby = F.col("language") == "ruby"
    found = lines.withColumn("s", _defined(SparkContext._active_spark_context))
    before = F.substring("text", F.lit(1), F.instr("text", F.col("s.name")) - 1)
    opened = F.greatest(F.size(F.regexp_extract_all(before, F.lit(R.RUBY_BLOCKS), 0)) - 1, F.lit(0))
    at = F.when(ruby, opened).otherwise(F.length(before) - F.length(F.regexp_replace(before, R.BRACKETS, "")))
    there = F.col("s").isNotNull()
    return found.select("file", "language", "line", "text", "s", F.when(there, at).alias("at"), F.when(there, ruby & F.col("text").rlike(R.RUBY_ENDLESS)).alias("one_line"))


def symbols_of(lines: DataFrame) -> DataFrame:
    """Symbols of ``bare_lines``: name, kind, file, language, line, is_exported, at, one_line."""
    return with_symbols(lines).where("s is not null").select("s.name", "s.kind", "file", "language", "line", "s.is_exported", "at", "one_line")


def symbols(files: DataFrame) -> DataFrame:
    """name, kind, file, line, is_exported, prov_source, prov_confidence; the first rule of a line wins."""
    return symbols_of(bare_lines(files)).select("name", "kind", "file", "line", "is_exported", F.lit("lexical").alias("prov_source"), F.lit(R.SYMBOL).alias("prov_confidence"))


def calls(files: DataFrame) -> DataFrame:
    """src_file, line, dst_symbol: each name once for each line, but what the line defines."""
    text = F.col("text")
    for language, pattern in R.NOT_CALLS.items():
        text = F.when(F.col("language") == language, F.regexp_replace(text, pattern, " (")).otherwise(text)
    called = F.array_distinct(F.regexp_extract_all(text, F.lit(R.CALL_PATTERN), 1))
    rows = bare_lines(files).where(F.contains("text", F.lit("("))).select("file", "line", _defined(SparkContext._active_spark_context)["name"].alias("own"), F.explode(called).alias("dst_symbol"))
    return rows.where(~F.col("dst_symbol").isin(*R.NOT_CALLED) & ~F.col("dst_symbol").eqNullSafe(F.col("own"))).select(F.col("file").alias("src_file"), "line", "dst_symbol")


def edges(files: DataFrame) -> DataFrame:
    """src_file, src_symbol (null until attributed), rel, dst_file, dst_symbol, line for calls, imports and inheritance."""
    text, none = F.col("text"), F.lit(None).cast("string")

    def edge(rel: str, src: Column, dst_file: Column, dst: Column) -> Column:
        return F.struct(F.lit(rel).alias("rel"), src.alias("src_symbol"), dst_file.alias("dst_file"), dst.alias("dst_symbol"))

    parts = []
    for languages, pattern in R.IMPORT_RULES:
        parts.append(_guarded(languages, F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda m: edge("imports", none, m, none))))
    for languages, pattern in R.EXTENDS_RULES:
        one = F.array(edge("extends", F.regexp_extract(text, pattern, 1), none, F.regexp_extract(text, pattern, 2)))
        parts.append(_guarded(languages, F.when(text.rlike(pattern), one).otherwise(F.array())))
    rows = code_lines(files).select(F.col("file").alias("src_file"), "language", "line", F.explode(F.concat(*parts)).alias("e"))
    found = rows.select("src_file", "e.src_symbol", "e.rel", "e.dst_file", "e.dst_symbol", "line")
    called = calls(files).select("src_file", none.alias("src_symbol"), F.lit("calls").alias("rel"), none.alias("dst_file"), "dst_symbol", "line")
    return found.unionByName(called).unionByName(grouped_imports(files))


def grouped_imports(files: DataFrame) -> DataFrame:
    """Edges of Go's imports in brackets, one for each path."""
    own = files.where("language = 'go'")
    blocks = _coded(own).select("file", F.explode(matches(F.col("code"), R.GO_IMPORTS, lambda text, line: F.struct(text.alias("text"), line.alias("line")))).alias("b"))
    rows = blocks.select("file", "b.line", F.posexplode(F.split("b.text", "\n")).alias("i", "text"))
    path, none = F.nullif(F.regexp_extract("text", R.GO_IMPORT, 1), F.lit("")), F.lit(None).cast("string")
    found = rows.select(F.col("file").alias("src_file"), none.alias("src_symbol"), F.lit("imports").alias("rel"), path.alias("dst_file"), none.alias("dst_symbol"), (F.col("line") + F.col("i")).alias("line"))
    return found.where("dst_file is not null")


def middleware(files: DataFrame) -> DataFrame:
    """file, language, src, middleware: the names that a file installs, in order of first use."""
    found = F.concat(*[_guarded(langs, F.regexp_extract_all("src", F.lit(p), 1)) for langs, p in R.MIDDLEWARE_RULES])
    return files.withColumn("middleware", F.array_distinct(found.cast("array<string>")))


_HINT = "array<struct<fn_name:string,line:bigint,kind:string,framework:string,path:string,method:string,confidence:double,heuristic:string,ord:int,guard:string>>"


def _hint(fn: Column, line: Column, kind: str, framework: str | None, path: Column, method: Column, confidence: float, heuristic: str, number: int, guard: Column) -> Column:
    return F.struct(
        fn.alias("fn_name"), line.cast("long").alias("line"), F.lit(kind).alias("kind"), F.lit(framework).cast("string").alias("framework"), path.alias("path"), F.upper(method).alias("method"),
        F.lit(confidence).alias("confidence"), F.lit(heuristic).alias("heuristic"), F.lit(number).alias("ord"), guard.alias("guard"),
    )


def pattern_hints(src: Column, odd: Column | None = None) -> Column:
    """Array of the hints that the hint rules and main marks give for a file."""
    none = F.lit(None).cast("string")

    def row(h: R.Hint, number: int):
        def make(text: Column, line: Column) -> Column:
            group = lambda g: F.nullif(F.regexp_extract(text, h.pattern, g), F.lit("")) if g else none
            return _hint(F.coalesce(group(h.fn), F.lit(h.name)), line, h.kind, h.framework, group(h.path), group(h.method), h.confidence, h.heuristic, number, group(h.guard))

        return make

    def main(language: str, mark: str, confidence: float) -> Column:
        made = _hint(F.lit("main"), F.lit(None), "main", None, none, none, confidence, "main_fn", len(R.HINT_RULES), none)
        return F.when((F.col("language") == language) & F.contains(src, F.lit(mark)), F.array(made)).otherwise(F.array())

    found = [_guarded(h.languages, matches(src, h.pattern, row(h, i), odd)) for i, h in enumerate(R.HINT_RULES)]
    return F.concat(*[F.coalesce(x, F.array()).cast(_HINT) for x in (*found, *[main(*m) for m in R.MAIN_MARKS])])


def injected(src: Column) -> Column:
    """Array of (fn, names, line): Python functions with injected parameters, and what is injected."""
    make = lambda text, line: F.struct(F.regexp_extract(text, R.DEPENDS_PATTERN, 1).alias("fn"), F.regexp_extract_all(text, F.lit(R.DEPENDS_NAME), 1).alias("names"), line.alias("line"))
    return F.coalesce(_guarded(("python",), matches(src, R.DEPENDS_PATTERN, make)), F.array()).cast("array<struct<fn:string,names:array<string>,line:bigint>>")


def controller_actions(file: Column, src: Column) -> Column:
    """Array of (fn, line): the public actions of a Rails controller, as prefix#action."""
    prefix = S.camel_to_snake(F.regexp_extract(src, R.CONTROLLER_CLASS, 1))
    public = F.get(F.split(src, R.PRIVATE_MARK, 2), F.lit(0))
    action = lambda text: F.regexp_extract(text, R.ACTION_PATTERN, 1)
    # a match may begin with line feeds before its own line
    make = lambda text, line: F.struct(action(text).alias("action"), (line + newlines(text)).alias("line"))
    found = F.filter(matches(public, R.ACTION_PATTERN, make), lambda a: ~a["action"].startswith("_") & ~a["action"].isin(*R.NOT_ACTIONS))
    named = F.transform(found, lambda a: F.struct(F.when(prefix == "", a["action"]).otherwise(F.concat_ws("#", prefix, a["action"])).alias("fn"), a["line"].alias("line")))
    is_one = (file.contains("controllers") | src.contains("< ApplicationController")) & src.contains("Controller")
    return F.when((F.col("language") == "ruby") & is_one, named).otherwise(F.array()).cast("array<struct<fn:string,line:bigint>>")


def extractor_functions(src: Column) -> Column:
    """Array of (fn, line): Rust functions whose parameters show that they handle requests."""
    make = lambda text, line: F.struct(F.regexp_extract(text, R.EXTRACTOR_PATTERN, 1).alias("fn"), line.alias("line"))
    return F.coalesce(_guarded(("rust",), matches(src, R.EXTRACTOR_PATTERN, make)), F.array()).cast("array<struct<fn:string,line:bigint>>")


def entry_hints(files: DataFrame) -> DataFrame:
    """fn_name, file, line, kind, framework, path, method, confidence, heuristic, middleware, ord.

    Hints of weaker producers (Rails resources and controller actions, Rust functions with
    request parameters, Python functions with injected ones) only come for functions that
    have none yet in their file. Middleware is a route's own wrapper or injected functions,
    else what its file installs.
    """
    none, n = F.lit(None).cast("string"), len(R.HINT_RULES)
    src = F.col("src")
    base = middleware(files).withColumn("odd", has_marks(src)).select("file", "language", "src", "middleware", pattern_hints(src, F.col("odd")).alias("found"), injected(src).alias("injected"), resources(src).alias("resources"))
    names = F.transform("found", lambda h: h["fn_name"])
    weak = lambda f, line, framework, confidence, heuristic, path=none, method=none: _hint(f, line, "route", framework, path, method, confidence, heuristic, n + 1, none)
    fresh = lambda rows, name, *seen: F.filter(rows, lambda r: ~F.array_contains(F.concat(*seen), name(r)))
    of_resources = F.transform(fresh(F.col("resources"), lambda r: r["fn_name"], names), lambda r: weak(r["fn_name"], r["line"], "rails", 0.85, "resources", r["path"], r["method"]))
    seen = F.concat(names, F.transform("resources", lambda r: r["fn_name"]))
    actions = F.filter(controller_actions(F.col("file"), src), lambda a: ~F.array_contains(seen, a["fn"]) & ~F.array_contains(seen, F.element_at(F.split(a["fn"], "#"), -1)))
    extractors = F.filter(extractor_functions(src), lambda a: ~F.exists("found", lambda h: (h["kind"] == "route") & (h["fn_name"] == a["fn"])))
    depending = F.filter("injected", lambda a: ~F.array_contains(names, a["fn"]))
    more = [
        of_resources,
        F.transform(actions, lambda a: weak(a["fn"], a["line"], "rails", 0.80, "controller_action")),
        F.transform(extractors, lambda a: weak(a["fn"], a["line"], "axum", 0.75, "extractor_fn")),
        F.transform(depending, lambda a: weak(a["fn"], a["line"], "fastapi", 0.80, "depends_fn")),
    ]
    rows = base.select("file", "middleware", "injected", F.explode(F.concat("found", *[m.cast(_HINT) for m in more])).alias("h")).select("h.*", "file", "middleware", "injected")
    own = F.flatten(F.transform(F.filter("injected", lambda a: a["fn"] == F.col("fn_name")), lambda a: a["names"]))
    names_of = F.when(F.col("guard").isNotNull(), F.array("guard")).when(F.size(own) > 0, own).otherwise(F.col("middleware"))
    return rows.withColumn("middleware", names_of).drop("guard", "injected")


def resources(src: Column) -> Column:
    """Array of (fn_name, path, method, line) of Rails ``resources :name``: seven each, six for ``resource``."""
    pattern = r"(?:^|[\s;])(resources?)\s+:(\w+)"

    def make(text: Column, line: Column) -> Column:
        name, plural = F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 1) == "resources"
        line = line + F.when(text.startswith("\n"), F.lit(1)).otherwise(F.lit(0))  # a match may begin with the line feed before
        rows = [F.struct(F.concat_ws("#", name, F.lit(action)).alias("fn_name"), F.concat(F.lit("/"), name, F.lit(tail)).alias("path"), F.lit(verb).alias("method"), line.alias("line")) for action, verb, tail in R.RESOURCE_ACTIONS]
        return F.when(plural, F.array(*rows)).otherwise(F.array(*[r for r, a in zip(rows, R.RESOURCE_ACTIONS) if a[0] != "index"]))

    return F.coalesce(_guarded(("ruby",), F.flatten(matches(src, pattern, make))), F.array()).cast("array<struct<fn_name:string,path:string,method:string,line:bigint>>")


def resource_hints(files: DataFrame) -> DataFrame:
    """Hints of Rails ``resources :name``: seven rows, six for ``resource``."""
    return files.select("file", F.explode(resources(F.col("src"))).alias("r")).select("r.*", "file")


def file_meta_counts(files: DataFrame) -> DataFrame:
    """file, lines, exports, imports: counts of plain substrings."""
    src = F.col("src")
    count = lambda words: sum((((F.length(src) - F.length(F.replace(src, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in words), F.lit(0).cast("long"))
    pick = lambda side: F.coalesce(*[F.when(F.col("language") == lang, count(words[side])) for lang, words in R.META_COUNTS.items()], F.lit(0).cast("long"))
    return files.select("file", (newlines(src) + 1).cast("long").alias("lines"), pick(0).alias("exports"), pick(1).alias("imports"))


def transport(files: DataFrame) -> DataFrame:
    """One row: whether any Rust source shows a gRPC transport."""
    shown = [F.contains("src", F.lit(m)) for m in R.TRANSPORT_MARKS]
    any_of = shown[0] | shown[1] | shown[2] | shown[3]
    return files.where("language = 'rust'").agg(F.coalesce(F.bool_or(any_of), F.lit(False)).alias("has_transport"))
