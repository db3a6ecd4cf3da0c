"""The queries of the library, by name, with the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave import rules as R
from factweave import views as V
from factweave.functions import scalars as S
from factweave.operators import attribute, entrypoints, explore, extract, graph, report, scopes, topology
from factweave.plans.index import Config, index
from factweave.sources.files import snapshot_status
from factweave.storage import materialize

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, with the SQL for the same rows where there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


# --- files -------------------------------------------------------------------------------


@query(f"with {V.SRC_SQL} select file, language from src_files")
def ext_language_lookup(spark, sf_dir):
    return V.src_files(spark, sf_dir).select("file", S.language_of(F.col("file")).alias("language"))


@query("select distinct lang as language from documents where lang <> ''")
def distinct_languages(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").where("lang <> ''").select(F.col("lang").alias("language")).distinct()


@query("select doc_id, sha256(text) as sha256 from documents")
def content_sha256(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""with old as (select doc_id, case when source = 'src3' then sha256(text || 'x') else sha256(text) end as sha256 from documents where lang <> 'es')
select d.doc_id as file, sha256(d.text) as sha256, case when old.sha256 is null then 'New' when old.sha256 <> sha256(d.text) then 'Changed' else 'Unchanged' end as status
from documents d left join old using (doc_id)""")
def snapshot_diff_status(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "file")
    old = docs.where("lang <> 'es'").select("file", F.sha2(F.when(F.col("source") == "src3", F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return snapshot_status(docs.select("file", F.sha2("text", 256).alias("sha256")), old)


@query(f"with {V.SRC_SQL} select count(*) as files, count(distinct language) as languages, cast(sum(length(src) - length(replace(src, chr(10), '')) + 1) as bigint) as lines from src_files")
def run_summary(spark, sf_dir):
    return explore.run_summary(V.src_files(spark, sf_dir))


@query(f"with {V.SRC_SQL} select bool_or({' or '.join(f'contains(src, {text(m)})' for m in R.TRANSPORT_MARKS)}) as has_transport from src_files where language = 'rust'")
def transport_detect(spark, sf_dir):
    return extract.transport(V.src_files(spark, sf_dir))


def _count(w: str) -> str:
    w = " || ".join(["chr(10)" if p == "\n" else text(p) for p in ([w] if "\n" not in w else ["\n", w.replace("\n", "")])])
    return f"(length(src) - length(replace(src, {w}, ''))) // length({w})"


def _meta(side: int) -> str:
    return "case language " + " ".join(f"when '{lang}' then {' + '.join(_count(w) for w in v[side])}" for lang, v in R.META_COUNTS.items()) + " else 0 end"


@query(f"with {V.SRC_SQL} select file, cast(length(src) - length(replace(src, chr(10), '')) + 1 as bigint) as lines, cast({_meta(0)} as bigint) as exports, cast({_meta(1)} as bigint) as imports from src_files")
def file_meta_counts(spark, sf_dir):
    return extract.file_meta_counts(V.src_files(spark, sf_dir))


# --- extraction --------------------------------------------------------------------------


def _stated(columns: str, rows) -> str:
    """SQL for rows that are stated for each language: (language, line, ...), @K@ the customer, @N@ its nation."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else text(v) if isinstance(v, str) else str(v)
    told = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"stated as (select file, t.*, cast(c_custkey as varchar) as k, cast(c_nationkey as varchar) as n from src_files join (values {told}) as t(language, {columns}) using (language))"


def _filled(c: str) -> str:
    return f"replace(replace({c}, '@K@', k), '@N@', n)"


#: What the sources define and call: language, line, name, kind, whether it is exported; language, names by line.
DEFINED = (
    ("javascript", 2, "Shop@K@", "class", False), ("javascript", 3, "Cart@K@", "class", False), ("javascript", 4, "save@K@", "function", False), ("javascript", 8, "load@K@", "function", True),
    ("typescript", 2, "Row@K@", "class", True), ("typescript", 3, "Desk@K@", "class", True), ("typescript", 4, "seat@K@", "function", False), ("typescript", 8, "make@K@", "function", True),
    ("python", 3, "Account@K@", "class", True), ("python", 4, "load_@K@", "function", True), ("python", 21, "show_@K@", "function", True), ("python", 24, "dep_@K@", "function", True), ("python", 28, "task_@K@", "function", True),
    ("ruby", 2, "Order@K@", "class", True), ("ruby", 5, "show_@K@", "function", True), ("ruby", 23, "list", "function", True), ("ruby", 26, "hidden_@K@", "function", True), ("ruby", 29, "Extra@K@", "class", True),
    ("rust", 2, "Store@K@", "class", True), ("rust", 4, "get_@K@", "function", True), ("rust", 17, "r_@K@", "function", False), ("rust", 20, "main", "function", False),
    ("go", 2, "Server@K@", "class", True), ("go", 3, "Handle@K@", "function", True), ("go", 11, "main", "function", False),
    ("java", 2, "Shop@K@", "class", True), ("java", 3, "show@K@", "function", True), ("java", 14, "on@K@", "function", True), ("java", 16, "calc@K@", "function", True), ("java", 18, "main", "function", True),
    ("php", 2, "Order@K@", "class", True), ("php", 4, "show@K@", "function", True),
)
CALLED = {
    "javascript": "1 require, 5 get, 10 setHeader, 11 set, 14 get, 15 hset, 16 send, 17 subscribe, 18 query, 19 fetch, 20 protoPost, 21 helper@N@, 24 use, 25 post, 26 readFile, 27 publish, 28 receiveMessage",
    "typescript": "5 encode, 5 finish, 9 get, 10 findMany, 11 sendMessage, 12 GetItem, 13 emit, 14 decode, 15 load@N@, 17 UseGuards, 18 get, 19 post, 20 consume, 21 fetch",
    "python": "5 getenv, 6 get, 7 execute, 8 set, 9 hget, 10 lpush, 11 get, 12 subscribe, 13 produce, 14 produce, 15 set_cookie, 16 GetUser, 17 insecure_channel, 18 helper@N@, 19 get, 21 Depends, 22 filter, 23 query, 24 Depends, 26 path, 31 load_@N@",
    "ruby": "7 fetch, 8 get, 9 set, 10 smembers, 11 sadd, 12 find_by, 13 sum, 15 execute, 16 perform_async, 17 produce, 19 get_user, 20 get, 21 get",
    "rust": "5 var, 6 query, 7 query_file, 8 get, 9 set, 10 hget, 11 decode, 12 decode, 13 encode_to_vec, 15 helper@N@, 18 route, 18 get, 19 route, 19 with_auth, 19 post",
    "go": "4 Getenv, 5 Query, 6 Get, 7 Set, 8 Unmarshal, 9 helper@N@, 12 HandleFunc, 13 GET",
    "java": "4 getenv, 5 update, 6 createQuery, 7 send, 8 hset, 9 get, 10 getForObject, 11 helper@N@",
    "php": "5 getenv, 6 select, 7 table, 8 query, 9 put, 10 get, 11 get, 12 set, 13 post, 14 request, 15 produce, 16 helper@N@, 19 get, 20 any",
}
_CALLED_ROWS = [(language, int(c.split()[0]), c.split()[1]) for language, told in CALLED.items() for c in told.split(", ")]


@query(f"with {V.SRC_SQL}, {_stated('line, name, kind, is_exported', DEFINED)} select {_filled('name')} as name, kind, file, cast(line as bigint) as line, is_exported from stated")
def extract_symbols(spark, sf_dir):
    return extract.symbols(V.src_files(spark, sf_dir)).drop("prov_source", "prov_confidence")


@query(f"with {V.SRC_SQL}, {_stated('line, name', _CALLED_ROWS)} select file as src_file, cast(line as bigint) as line, {_filled('name')} as dst_symbol from stated")
def extract_call_edges(spark, sf_dir):
    return extract.calls(V.src_files(spark, sf_dir))


#: Of the sources with nested functions (views.SCOPED): language, first line, name, kind, last line; language, lines of its events with their function.
SCOPES = (
    ("typescript", 1, "handle@K@", "function", 8), ("typescript", 4, "inner@N@", "function", 6), ("typescript", 11, "Box@K@", "class", 15), ("typescript", 12, "open@K@", "function", 14),
    ("java", 1, "Shop@K@", "class", 14), ("java", 2, "run@K@", "function", 11), ("java", 5, "call@N@", "function", 7), ("java", 12, "plain@K@", "function", 13),
    ("rust", 1, "outer@K@", "function", 7), ("rust", 2, "deep@N@", "function", 4), ("rust", 8, "tail@K@", "function", 8),
    ("go", 3, "Serve@K@", "function", 6), ("go", 8, "main", "function", 10),
    ("python", 2, "outer_@K@", "function", 9), ("python", 4, "inner_@N@", "function", 6), ("python", 11, "last_@K@", "function", 12),
    ("ruby", 1, "Task@K@", "class", 11), ("ruby", 2, "run_@K@", "function", 7), ("ruby", 8, "one_@N@", "function", 8), ("ruby", 9, "two_@K@", "function", 10),
    ("php", 1, "A@K@", "class", 7), ("php", 2, "f@K@", "function", 6), ("php", 8, "g@K@", "function", 9),
    ("javascript", 1, "load@K@", "function", 6), ("javascript", 8, "one@N@", "function", 8),
)
WITHIN = {
    "typescript": "2 handle@K@, 5 inner@N@, 7 handle@K@, 9 <module>, 13 open@K@, 16 <module>", "java": "3 run@K@, 6 call@N@, 10 run@K@, 13 plain@K@",
    "rust": "3 deep@N@, 6 outer@K@, 8 tail@K@, 9 <module>", "go": "4 Serve@K@, 5 Serve@K@, 9 main", "python": "3 outer_@K@, 6 inner_@N@, 9 outer_@K@, 10 <module>, 12 last_@K@, 13 <module>",
    "ruby": "4 run_@K@, 6 run_@K@, 8 one_@N@, 10 two_@K@, 12 <module>", "php": "4 f@K@, 5 f@K@, 9 g@K@, 10 <module>", "javascript": "3 load@K@, 5 load@K@, 7 <module>, 8 one@N@, 9 <module>",
}
_WITHIN_ROWS = [(language, int(c.split()[0]), c.split()[1]) for language, told in WITHIN.items() for c in told.split(", ")]


@query(f"with {V.SCOPED_SQL}, {_stated('line, name, kind, last', SCOPES)} select {_filled('name')} as name, kind, file, cast(line as bigint) as line, cast(last as bigint) as end_line from stated")
def function_scopes(spark, sf_dir):
    """Where the functions and classes of nested sources begin and end."""
    return scopes.scopes(V.scoped_files(spark, sf_dir)).select("name", "kind", "file", "line", "end_line")


@query(f"with {V.SCOPED_SQL}, {_stated('line, name', _WITHIN_ROWS)} select file, cast(line as bigint) as line, {_filled('name')} as fn_name from stated")
def scope_attribution(spark, sf_dir):
    """Environment reads of nested sources, each in its innermost function; commented ones aren't read."""
    files = V.scoped_files(spark, sf_dir)
    events = extract.boundary_events(files, [r for r in (*R.CALL_RULES, *R.EVENT_RULES) if r.medium == "env"]).select("file", "line", "fn_name").distinct()
    parts = scopes.parts_of(files)
    return scopes.enclosing(events, scopes.scopes(files, parts), parts=parts)


@query(f"with {V.SRC_SQL} " + " union all ".join(f"select file as src_file, cast(line as bigint) as line, unnest(regexp_extract_all(text, {text(p)}, 1)) as dst_file from lines where language in {words(langs)}" for langs, p in R.IMPORT_RULES))
def extract_import_edges(spark, sf_dir):
    return extract.edges(V.src_files(spark, sf_dir)).where("rel = 'imports'").select("src_file", "line", "dst_file")


@query(f"with {V.SRC_SQL} " + " union all ".join(f"select file as src_file, cast(line as bigint) as line, regexp_extract(text, {text(p)}, 1) as src_symbol, regexp_extract(text, {text(p)}, 2) as dst_symbol from lines where language in {words(langs)} and regexp_matches(text, {text(p)})" for langs, p in R.EXTENDS_RULES))
def extract_extends_edges(spark, sf_dir):
    return extract.edges(V.src_files(spark, sf_dir)).where("rel = 'extends'").select("src_file", "line", "src_symbol", "dst_symbol")


def _norm(e: str) -> str:
    for p in (r"\$\{[^}]*\}", r"\{[^}]+\}", r"%[dsfv]|%\([^)]+\)[dsfv]", r"\s*\+\s*\w+\s*$"):
        e = f"regexp_replace({e}, {text(p)}, '{{}}', 'g')"
    return f"trim({e})"


def _verb(e: str) -> str:
    first = f"upper(regexp_extract({e}, '^\\s*(\\w+)', 1))"
    return f"case when {first} in ('SELECT', 'WITH') then 'read' when {first} in ('INSERT', 'UPDATE', 'DELETE', 'MERGE', 'UPSERT') then 'write' else 'read' end"


def _base(e: str) -> str:
    rest = f"regexp_replace({e}, '^https?://', '')"
    return f"case when starts_with({e}, '/') then {e} when instr({rest}, '/') > 0 then substr({rest}, instr({rest}, '/')) else '' end"


def _outgoing(e: str) -> str:
    path = f"rtrim({_base(f'regexp_replace({e}, {text(chr(92) + "$" + chr(92) + "{[^}]*" + chr(92) + "}")}, {text(":param")}, {text("g")})')}, '/')"
    return f"case when length({path}) > 1 then {path} end"


def _tables(e: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({e}, {text(R.TABLE_PATTERN)}, 1), lambda x: lower(x)), lambda x: x not in {words(R.RESERVED)})"


def _header(e: str) -> str:
    return f"case when lower({e}) in {words(R.HEADER_NAMES)} or starts_with(lower({e}), 'x-') then 'http_header' else 'redis' end"


def _literal(e: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(trim({e}), '^&', ''), '^r#*\"', ''), '^\"|\"#*$', '', 'g')"


def _rule_sql(r: R.Rule) -> str:
    p = text(r.pattern)
    key = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {p}, {g}), '')" for g in r.key) + ")"
    if r.strip:
        key = _literal(key)
    if r.never:
        key = f"case when {key} not in {words(r.never)} then {key} end"
    group = lambda g: f"regexp_extract(text, {p}, {g})"
    direction = {
        "read": "'read'", "write": "'write'", "header": "'read'", "verb": _verb(key),
        "select": f"case when contains(upper({key}), 'SELECT') then 'read' else 'write' end",
        "find": f"case when regexp_matches({group(2)}, '^(find|count)') then 'read' else 'write' end",
        "manager": f"case when {group(2)} in ('filter', 'get', 'all', 'first', 'last') then 'read' else 'write' end",
        "session": f"case when {group(1)} = 'query' then 'read' else 'write' end",
        "file": f"case when contains({group(1)}, 'read') then 'read' else 'write' end",
    }[r.direction]
    medium = _header(key) if r.direction == "header" else f"'{r.medium}'"
    out = _outgoing(key) if r.medium == "http_out" else key
    keys = _tables(key) if r.medium == "sql" and r.direction in ("select", "verb") else f"[{out}]"
    return f"select file, cast(line as bigint) as line, {direction} as direction, {medium} as medium, {out} as key_raw, unnest({keys}) as k, '{r.name}' as rule from lines where language in {words(r.languages)} and regexp_matches(text, {p})"


def _events_sql(medium: str) -> str:
    rules = [r for r in (*R.CALL_RULES, *R.EVENT_RULES) if r.enabled and (r.medium == medium or r.direction == "header")]
    return f"with {V.SRC_SQL}, e as ({' union all '.join(map(_rule_sql, rules))}) select file, line, direction, {_norm('k')} as key_norm, rule from e where medium = '{medium}' and key_raw is not null"


def _boundary(medium: str):
    def run(spark, sf_dir):
        rules = [r for r in (*R.CALL_RULES, *R.EVENT_RULES) if r.medium == medium or r.direction == "header"]
        return extract.boundary_events(V.src_files(spark, sf_dir), rules).where(F.col("medium") == medium).select("file", "line", "direction", "key_norm", "rule")

    return run


for _medium in ("env", "redis", "kafka", "sql", "http_header", "http_out", "rabbitmq", "sqs", "filesystem", "grpc", "queue", "websocket", "cookie"):
    query(_events_sql(_medium), f"boundary_{_medium}")(_boundary(_medium))

# --- scalars -----------------------------------------------------------------------------

#: Statements and keys with an order's number in them.
STATEMENTS = ("SELECT a FROM t@ WHERE x", "insert into T@ values (1)", "UPDATE u@ SET a", "WITH q AS (SELECT 1 FROM w@) SELECT * FROM a JOIN b@", "DELETE FROM d@", "MERGE INTO m@ USING s", "EXPLAIN x@")
KEYS = ("session:${id@}", "user:{u@}", "a%d:@", "k@ + suffix", "%(name)s:@", "Authorization", "x-zone-@", "plain@")


def _templates(spark, sf_dir, templates) -> DataFrame:
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*[F.replace(F.lit(t), F.lit("@"), F.col("o_orderkey").cast("string")) for t in templates])).alias("t"))


def _templates_sql(templates) -> str:
    return f"t as (select o_orderkey, unnest([{', '.join(f'replace({text(t)}, {text("@")}, cast(o_orderkey as varchar))' for t in templates)}]) as t from orders)"


def _after(w: str) -> str:
    return f"nullif(regexp_extract(regexp_replace(t, '\\s+', ' ', 'g'), '(?i){w} (\\S+)', 1), '')"


SCALARS = {
    "sql_verb_direction": (STATEMENTS, S.sql_verb, _verb("t")),
    "sql_primary_table": (STATEMENTS, S.sql_primary_table, f"lower(regexp_replace(coalesce({', '.join(map(_after, ('FROM', 'INTO', 'UPDATE', 'JOIN')))}), '^\\W+|\\W+$', '', 'g'))"),
    "header_reclassify": (KEYS, S.header_medium, _header("t")),
    "normalise_key": (KEYS, S.normalise_key, _norm("t")),
    "strip_literal": (('&"lit@"', 'r#"raw@"#', '"plain@"', "bare@"), S.strip_literal, _literal("t")),
    "strip_base_url": (("https://api.example.com/foo/@", "https://api.example.com", "/x/@", "rel@/path"), S.strip_base_url, _base("t")),
    "template_interp": (("/users/${id}/comments/${c@}", "/plain/@"), S.template_path, "regexp_replace(t, '\\$\\{[^}]*\\}', ':param', 'g')"),
    "camel_to_snake": (("UserProfilesController", "Api@Controller", "plain"), S.camel_to_snake, "lower(regexp_replace(regexp_replace(t, 'Controller$', ''), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"),
}


def _scalar(templates, f):
    return lambda spark, sf_dir: _templates(spark, sf_dir, templates).select("o_orderkey", F.col("t").alias("input"), f(F.col("t")).alias("output"))


for _name, (_t, _f, _sql) in SCALARS.items():
    query(f"with {_templates_sql(_t)} select o_orderkey, t as input, {_sql} as output from t", _name)(_scalar(_t, _f))


@query(f"with {_templates_sql(STATEMENTS)} select o_orderkey, t as input, unnest({_tables('t')}) as name from t")
def sql_tables_explode(spark, sf_dir):
    return _templates(spark, sf_dir, STATEMENTS).select("o_orderkey", F.col("t").alias("input"), F.explode(S.sql_tables(F.col("t"))).alias("name"))


def _service_sql(file: str) -> str:
    parts = f"list_filter(string_split({file}, '/')[1:-2], lambda p: p not in ('', '.', '..'))"
    return f"case when len({parts}) = 0 then 'root' when len({parts}) <= 2 then {parts}[1] else coalesce(list_filter({parts}, lambda p: p not in {words(R.LAYOUT_DIRS)})[-1], {parts}[-1]) end"


PATHS = ("/home/user/project/svc@/src/main.rs", "./core-@/src/lib.rs", "main@.rs", "p/svc@/static/app.js", "a/src/services/billing/x@.py", "billing/app/y@.py", "src/lib/test/z@.go")


@query(f"with {_templates_sql(PATHS)} select o_orderkey, t as file, {_service_sql('t')} as service from t")
def service_from_path(spark, sf_dir):
    return _templates(spark, sf_dir, PATHS).select("o_orderkey", F.col("t").alias("file"), S.service_from_path(F.col("t")).alias("service"))


_inside = "regexp_matches(array_to_string(list_filter(string_split(t, '/'), lambda p: p not in ('', '.')), '/'), '(^|/)src/services/[^/]+/[^/]+') and len(list_filter(string_split(t, '/'), lambda p: p not in ('', '.'))) >= 4"


@query(f"with {_templates_sql(PATHS)} select {_service_sql('t')} as service from t where {_inside} intersect select {_service_sql('t')} from t where not ({_inside})")
def colliding_services_intersect(spark, sf_dir):
    return topology.colliding(_templates(spark, sf_dir, PATHS).withColumnRenamed("t", "file"))


HOVERS = ("const c: Redis", "```typescript\nMap<a@>```", "KafkaProducer", "db.Pool", "IncomingMessage", "plain text @", "```rust fn x```", "tonic stub")


def _hover_sql() -> str:
    has = lambda ws: "(" + (" or ".join(f"contains(lower(t), {text(w)})" for w in ws) or "false") + ")"
    return "case m " + " ".join(f"when '{m}' then case when {has(y)} then 'Confirmed' when {has(n)} or {has(R.TYPED_HOVER)} then 'Rejected' else 'Unknown' end" for m, (y, n) in R.HOVER.items()) + " else 'Unknown' end"


_MEDIA = (*R.HOVER, "env")


@query(f"with {_templates_sql(HOVERS)}, u as (select o_orderkey, t, unnest([{', '.join(map(text, _MEDIA))}]) as m from t) select o_orderkey, t as input, m as medium, {_hover_sql()} as verdict from u")
def classify_hover(spark, sf_dir):
    rows = _templates(spark, sf_dir, HOVERS).withColumn("medium", F.explode(F.array(*[F.lit(m) for m in _MEDIA])))
    return rows.select("o_orderkey", F.col("t").alias("input"), "medium", S.classify_hover(F.col("t"), F.col("medium")).alias("verdict"))


# --- attribution -------------------------------------------------------------------------


@query("""with s as (select user_id, event_id, event_id as f from events where event_type = 'signup'), e as (select user_id, event_id from events where event_type <> 'signup')
select e.user_id as file, e.event_id as line, coalesce('f' || s.f, '<module>') as fn_name from e asof left join s on e.user_id = s.user_id and e.event_id >= s.event_id""")
def asof_attribute_events(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), "event_type")
    marks = rows.where("event_type = 'signup'").select("file", "line", F.concat(F.lit("f"), "line").alias("name"), F.lit("function").alias("kind"))
    return attribute.attribute_events(rows.where("event_type <> 'signup'").drop("event_type").withColumn("fn_name", F.lit("<module>")), marks)


@query("""with s as (select user_id, event_id, event_type from events where event_type in ('signup', 'purchase')), e as (select user_id, event_id from events where event_type not in ('signup', 'purchase'))
select e.user_id as src_file, e.event_id as line, s.event_type || s.event_id as src_symbol from e asof left join s on e.user_id = s.user_id and e.event_id >= s.event_id""")
def asof_attribute_edges(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("src_file"), F.col("event_id").alias("line"), "event_type")
    kind = F.when(F.col("event_type") == "signup", F.lit("function")).otherwise(F.lit("class"))
    marks = rows.where("event_type in ('signup', 'purchase')").select(F.col("src_file").alias("file"), "line", F.concat("event_type", "line").alias("name"), kind.alias("kind"))
    return attribute.attribute_edges(rows.where("event_type not in ('signup', 'purchase')").drop("event_type").withColumn("src_symbol", F.lit(None).cast("string")), marks)


@query(f"""with {V.FACTS_SQL}, g as (select *, row_number() over (partition by file, fn_name, medium order by ord, key_norm) as n from facts)
select fn_name, medium, line, prov_source from g where n = 1 or prov_source <> 'regex'""")
def merge_dedup_first_wins(spark, sf_dir):
    # a user counts as one line of its file
    rows = V.facts(spark, sf_dir).withColumn("event", F.col("line")).withColumn("line", F.substring("fn_name", 2, 20).cast("long"))
    return attribute.merge_first_wins(rows).select("fn_name", "medium", F.col("event").alias("line"), "prov_source")


@query(f"with {V.FACTS_SQL} select fn_name, line, prov_confidence from facts where prov_confidence >= 0.5")
def confidence_filter(spark, sf_dir):
    return attribute.confidence_filter(V.facts(spark, sf_dir)).select("fn_name", "line", "prov_confidence")


@query(f"with {V.FACTS_SQL} select fn_name, line, medium from facts where prov_source <> 'regex' and line is not null and medium in {words(R.VERIFIABLE)}")
def verifiable_events(spark, sf_dir):
    return attribute.verifiable(V.facts(spark, sf_dir)).select("fn_name", "line", "medium")


@query(f"with {V.FACTS_SQL}, v as (select fn_name, medium, key_norm, arg_max(case when value > 50 then 0.97 else 0.15 end, event_id) as c from facts join events on event_id = line where event_type = 'click' group by all) select f.fn_name, f.line, coalesce(v.c, f.prov_confidence)::double as prov_confidence from facts f left join v using (fn_name, medium, key_norm)")
def confidence_overlay(spark, sf_dir):
    facts = V.facts(spark, sf_dir)
    clicks = V.table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").cast("long").alias("line"), F.when(F.col("value") > 50, F.lit(0.97)).otherwise(F.lit(0.15)).alias("confidence"))
    verdicts = facts.join(clicks, "line").select("fn_name", "file", "medium", "key_norm", "confidence", F.lit("hover").alias("note"), "ord")
    return attribute.overlay_verdicts(facts, verdicts).select("fn_name", "line", "prov_confidence")


# --- entry points ------------------------------------------------------------------------


def _hint_sql(h: R.Hint) -> str:
    each = lambda g: f"unnest(regexp_extract_all(src, {text(h.pattern)}, {g}))"
    name = each(h.fn) if h.fn else f"case when {each(0)} is not null then '{h.name}' end"
    return f"select file, {name} as fn_name, {f'upper({each(h.method)})' if h.method else 'null'} as method, {each(h.path) if h.path else 'null'} as path, '{h.framework}' as framework, '{h.heuristic}' as heuristic, {h.confidence}::double as confidence, {each(h.guard) if h.guard else 'null'} as guard from src_files where language in {words(h.languages)} and regexp_matches(src, {text(h.pattern)})"


HINT_MADE = ("resources", "controller_action", "extractor_fn", "depends_fn")


@query(f"with {V.SRC_SQL}, h as ({' union all '.join(map(_hint_sql, R.HINT_RULES))}) select file, fn_name, method, path, framework, heuristic, confidence from h")
def hints_routes(spark, sf_dir):
    rows = extract.entry_hints(V.src_files(spark, sf_dir)).where(F.col("kind").isin("route", "cron") & ~F.col("heuristic").isin(*HINT_MADE))
    return rows.select("file", "fn_name", "method", "path", "framework", "heuristic", "confidence")


@query(f"with {V.SRC_SQL}, h as ({' union all '.join(_hint_sql(h) for h in R.HINT_RULES if h.guard)}) select file, fn_name, path, guard from h")
def hints_wrapped_routes(spark, sf_dir):
    rows = extract.entry_hints(V.src_files(spark, sf_dir)).where("framework = 'axum' and heuristic = 'route_decorator' and size(middleware) = 1")
    return rows.select("file", "fn_name", "path", F.get("middleware", F.lit(0)).alias("guard"))


# a template's own expected rows, as text: what is found in the source doesn't come from the rules here
@query("""select 'svc' || c_nationkey || '/src/python/file' || c_custkey || '.py' as file, unnest(['dep_' || c_custkey, 'show_' || c_custkey]) as fn_name, unnest(['depends_fn', 'route_decorator']) as heuristic, unnest(['user' || c_nationkey || ',db', 'session']) as names
from customer where c_custkey % 8 = 2""")
def hints_injected(spark, sf_dir):
    rows = extract.entry_hints(V.src_files(spark, sf_dir)).where("file like '%.py' and kind = 'route' and size(middleware) > 0")
    return rows.select("file", "fn_name", "heuristic", F.array_join("middleware", ",").alias("names"))


@query("""select 'svc' || c_nationkey || '/src/rust/file' || c_custkey || '.rs' as file, 'get_' || c_custkey as fn_name, 0.75::double as confidence from customer where c_custkey % 8 = 4
union all select 'svc' || c_nationkey || '/src/ruby/file' || c_custkey || '.rb', unnest(['order' || c_custkey || '#show_' || c_custkey, 'order' || c_custkey || '#list']), 0.80 from customer where c_custkey % 8 = 3""")
def hints_functions(spark, sf_dir):
    rows = extract.entry_hints(V.src_files(spark, sf_dir)).where("heuristic in ('extractor_fn', 'controller_action')")
    return rows.select("file", "fn_name", "confidence")


@query(f"with {V.SRC_SQL}, r as (select file, regexp_extract(text, '(?:^|[ \t;])(resources?)\\s+:(\\w+)', 2) as name, regexp_extract(text, '(?:^|[ \t;])(resources?)\\s+:', 1) = 'resources' as plural, cast(line as bigint) as line from lines where language = 'ruby' and regexp_matches(text, '(?:^|[ \t;])(resources?)\\s+:(\\w+)')) select file, line, name || '#' || a.action as fn_name, a.verb as method, '/' || name || a.tail as path from r cross join (values {', '.join(str(a) for a in R.RESOURCE_ACTIONS)}) as a(action, verb, tail) where plural or a.action <> 'index'")
def hints_resources_expand(spark, sf_dir):
    return extract.resource_hints(V.src_files(spark, sf_dir)).select("file", "line", "fn_name", "method", "path")


@query(f"with {V.SRC_SQL} " + " union all ".join(f"select file, {c}::double as confidence from src_files where language = '{lang}' and contains(src, {text(mark)})" for lang, mark, c in R.MAIN_MARKS))
def hints_main(spark, sf_dir):
    return extract.entry_hints(V.src_files(spark, sf_dir)).where("kind = 'main'").select("file", "confidence")


@query(f"with {V.SRC_SQL}, m as (" + " union all ".join(f"select file, unnest(regexp_extract_all(src, {text(p)}, 1)) as name from src_files where language in {words(langs)}" for langs, p in R.MIDDLEWARE_RULES) + ") select file, string_agg(distinct name, ',' order by name) as names from m group by file")
def hints_middleware_collect(spark, sf_dir):
    rows = extract.middleware(V.src_files(spark, sf_dir)).where(F.size("middleware") > 0)
    return rows.select("file", F.array_join(F.array_sort("middleware"), ",").alias("names"))


@query("select 'c' || c_custkey as fn_name, c_mktsegment as file, min(c_nationkey)::bigint as line from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') group by all")
def exported_leaf_antijoin(spark, sf_dir):
    symbols = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_mktsegment").alias("file"), F.col("c_nationkey").cast("long").alias("line"), F.lit(True).alias("is_exported"))
    edges = V.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("calls")).otherwise(F.lit("imports")).alias("rel"), F.concat(F.lit("c"), "o_custkey").alias("dst_symbol"))
    return entrypoints.exported_leaves(symbols, edges)


def _points(spark, sf_dir) -> DataFrame:
    """Hints by order: the clerk's file is the priority, the route the customer."""
    none = F.lit(None).cast("string")
    o = V.table(spark, sf_dir, "orders")
    route = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("/c/"), "o_custkey"))
    return o.select(
        F.concat(F.lit("h"), "o_custkey").alias("fn_name"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").cast("long").alias("line"),
        F.when(route.isNull(), F.lit("cron")).otherwise(F.lit("route")).alias("kind"), none.alias("framework"), route.alias("path"), F.when(route.isNotNull(), F.lit("GET")).alias("method"),
        F.when(F.col("o_orderstatus") == "F", F.lit(0.9)).otherwise(F.lit(0.8)).alias("confidence"), F.col("o_orderstatus").alias("heuristic"), F.array().cast("array<string>").alias("middleware"), F.col("o_orderkey").cast("int").alias("ord"),
    )


@query("""select 'h' || o_custkey as fn_name, o_orderpriority as file, max(case when o_orderstatus = 'F' then 0.9 else 0.8 end)::double as confidence, cast(min(o_orderkey) as bigint) as line,
  arg_max(case when o_orderstatus = 'P' then 'cron' else 'route' end, o_orderkey) as kind, case when bool_or(o_orderstatus <> 'P') then '/c/' || o_custkey end as path from orders group by o_custkey, o_orderpriority""")
def entrypoint_merge(spark, sf_dir):
    hints = _points(spark, sf_dir)
    leaves = hints.select("fn_name", "file", "line").limit(0)
    return entrypoints.merge_entry_points(leaves, hints).select("fn_name", "file", "confidence", "line", "kind", "path")


@query()
def route_propagation(spark, sf_dir):
    """Entry points of the source files, routes carried to the files that define their handlers."""
    files = V.src_files(spark, sf_dir)
    symbols = materialize(extract.symbols(files), "symbols")
    calls = extract.calls(files).select(F.lit("calls").alias("rel"), "dst_symbol")
    points = materialize(entrypoints.merge_entry_points(entrypoints.exported_leaves(symbols, calls), extract.entry_hints(files)), "merged")
    return entrypoints.propagate_routes(points, symbols).select("fn_name", "file", "kind", "path", "method")


@query("""with p as (select o_custkey as k, o_orderpriority as file, arg_max(case when o_orderstatus = 'P' then 'cron' else 'route' end, o_orderkey) as kind, bool_or(o_orderstatus <> 'P') as has from orders group by all),
r as (select k, file from p where kind = 'route' and has), h as (select c_custkey as k, unnest(['1-URGENT', '5-LOW']) as home from customer)
select 'h' || p.k as fn_name, p.file, p.kind, case when p.has or exists (select 1 from r join h on h.k = r.k where r.k = p.k and h.home = p.file and r.file <> p.file) then '/c/' || p.k end as path from p""")
def route_propagation_homes(spark, sf_dir):
    """Routes of customers' handlers, carried to the two files that define each."""
    hints = _points(spark, sf_dir)
    points = entrypoints.merge_entry_points(hints.select("fn_name", "file", "line").limit(0), hints)
    homes = F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    symbols = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), "c_custkey").alias("name"), homes.alias("file"))
    return entrypoints.propagate_routes(points, symbols).select("fn_name", "file", "kind", "path")


@query("""with f as (select 'o' || o_orderkey as fn_name, 'p' || o_orderpriority[1] || '/src/x.py' as file, case when o_orderstatus = 'O' then '/o' end as path, o_custkey % 3 = 0 as io from orders)
select fn_name, file, path, 'p' || substr(file, 2, 1) as service from f where io or path is not null""")
def service_entries_kept(spark, sf_dir):
    """Orders as entry points: those with a route or with events stay, with the service of their folder."""
    o = V.table(spark, sf_dir, "orders")
    file = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1), F.lit("/src/x.py")).alias("file")
    points = o.select(F.concat(F.lit("o"), "o_orderkey").alias("fn_name"), file, F.when(F.col("o_orderstatus") == "O", F.lit("/o")).alias("path"))
    io = o.where("o_custkey % 3 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("start_fn"), file.alias("start_file"))
    return topology.service_entries(points, io, topology.services(points)).select("fn_name", "file", "path", "service")


@query("""with p as (select distinct 'h' || o_custkey as fn_name, o_orderpriority as file from orders), s as (select 'h' || c_custkey as name, '1-URGENT' as file from customer where c_acctbal > 0)
select fn_name, file from p where not exists (select 1 from s where name = fn_name) or exists (select 1 from s where name = fn_name and s.file = p.file)""")
def route_placeholder_removal(spark, sf_dir):
    points = _points(spark, sf_dir).select("fn_name", "file").distinct()
    symbols = V.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("h"), "c_custkey").alias("name"), F.lit("1-URGENT").alias("file"))
    return entrypoints.remove_placeholders(points, symbols)


# --- graph -------------------------------------------------------------------------------

_EDGES_SQL = "edges as (select distinct 's' || l_suppkey as src_symbol, 'f' || (l_suppkey % 7) as src_file, 'p' || (l_partkey // 2) as dst_symbol from lineitem), syms as (select distinct 'p' || (p_partkey // 2) as name, 'f' || p_size % 5 as file from part)"


def _edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Calls of suppliers to pairs of parts, and the one or two files that define a pair."""
    none = F.lit(None).cast("string")
    edges = V.table(spark, sf_dir, "lineitem").select(
        F.lit("calls").alias("rel"), F.concat(F.lit("s"), "l_suppkey").alias("src_symbol"), F.concat(F.lit("f"), F.col("l_suppkey") % 7).alias("src_file"),
        F.concat(F.lit("p"), F.floor(F.col("l_partkey") / 2)).alias("dst_symbol"), none.alias("dst_file"),
    ).distinct()
    symbols = V.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 2)).alias("name"), F.concat(F.lit("f"), F.col("p_size") % 5).alias("file"), F.lit("function").alias("kind")).distinct()
    return edges, symbols


@query(f"with {_EDGES_SQL} select src_symbol as src_fn, src_file, dst_symbol as dst_fn, min(s.file) as dst_file from edges join syms s on s.name = dst_symbol and s.file <> src_file group by all having count(distinct s.file) = 1")
def adjacency_unique_target(spark, sf_dir):
    return graph.adjacency_unique_target(*_edges(spark, sf_dir))


@query(f"with {_EDGES_SQL} select src_symbol, src_file, dst_symbol, n as definitions from edges join (select name, count(*) as n from syms group by 1 having count(*) > 1) on name = dst_symbol")
def ambiguous_edges(spark, sf_dir):
    return graph.ambiguous_calls(*_edges(spark, sf_dir)).select("src_symbol", "src_file", "dst_symbol", "definitions")


@query(f"with {V.CALLS_SQL} select distinct src_fn, src_file, dst_fn, dst_file from calls")
def adjacency_direct(spark, sf_dir):
    rows = V.calls(spark, sf_dir).select(F.lit("calls").alias("rel"), F.col("src_fn").alias("src_symbol"), "src_file", F.col("dst_fn").alias("dst_symbol"), "dst_file")
    return graph.adjacency_direct(rows)


@query(f"with {V.CALLS_SQL} select dst_fn as fn, count(*) as callers from calls group by 1")
def callers(spark, sf_dir):
    return explore.callers(V.calls(spark, sf_dir))


@query(f"with {V.CALLS_SQL} select src_fn as fn, string_agg(dst_fn, ',' order by dst_fn) as callees from calls group by 1")
def callees(spark, sf_dir):
    return explore.callees(V.calls(spark, sf_dir))


def _reached(spark, sf_dir, depth: int) -> DataFrame:
    starts = V.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("fn"), F.lit("orders").alias("file"))
    return graph.reach(starts, V.calls(spark, sf_dir), depth)


def _reach_sql(depth: int) -> str:
    return f"""with recursive {V.CALLS_SQL}, w as (select 'o' || o_orderkey as start_fn, 'o' || o_orderkey as fn, 'orders' as file, 0 as depth from orders
  union all select w.start_fn, c.dst_fn, c.dst_file, w.depth + 1 from w join calls c on c.src_fn = w.fn and c.src_file = w.file where w.depth < {depth}),
r as (select start_fn, fn, file, min(depth) as depth from w group by all)"""


@query(_reach_sql(2) + " select start_fn, fn, file from r")
def bounded_reachability(spark, sf_dir):
    return _reached(spark, sf_dir, 2).select("start_fn", "fn", "file")


@query(_reach_sql(6) + " select start_fn, fn, file, depth from r")
def reachability_min_depth(spark, sf_dir):
    return _reached(spark, sf_dir, 6).select("start_fn", "fn", "file", "depth")


@query(f"""with recursive {V.CALLS_SQL}, w as (select 'c' || c_custkey as start_fn, 'c' || c_custkey as fn, 'customers' as file, ['c' || c_custkey || '@customers'] as path from customer
  union all select w.start_fn, c.dst_fn, c.dst_file, list_append(w.path, c.dst_fn || '@' || c.dst_file) from w join calls c on c.src_fn = w.fn and c.src_file = w.file where len(w.path) <= 3 and not list_contains(w.path, c.dst_fn || '@' || c.dst_file))
select start_fn, array_to_string(path, ' ') as path, len(path) - 1 as depth from w""")
def trace_paths(spark, sf_dir):
    starts = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("fn"), F.lit("customers").alias("file"))
    return graph.paths(starts, V.calls(spark, sf_dir), 3).select("start_fn", F.array_join("path", " ").alias("path"), F.col("depth").cast("long").alias("depth"))


def _io(spark, sf_dir) -> DataFrame:
    return graph.reached_events(_reached(spark, sf_dir, 2), V.facts(spark, sf_dir))


_IO_SQL = _reach_sql(2) + f""", {V.FACTS_SQL}, io as (select r.start_fn, r.fn, r.file, medium, key_norm, key_raw, direction, line,
  row_number() over (partition by start_fn, medium, key_norm, direction order by depth, r.file, line, r.fn, ord) as n from r join facts f on f.fn_name = r.fn and f.file = r.file where prov_confidence >= 0.5)"""


@query(_IO_SQL + " select start_fn, fn, medium, key_norm, direction, line from io where n = 1")
def io_dedup_first(spark, sf_dir):
    return _io(spark, sf_dir).select("start_fn", "fn", "medium", "key_norm", "direction", "line")


@query(_IO_SQL + " select start_fn, coalesce(string_agg(distinct key_norm, ', ' order by key_norm) filter (medium = 'sql' and direction = 'write'), '') as sql_write, coalesce(string_agg(distinct key_norm, ', ' order by key_norm) filter (medium = 'redis' and direction = 'read'), '') as redis_read from io where n = 1 group by 1")
def io_by_medium_direction(spark, sf_dir):
    return report.io_columns(_io(spark, sf_dir)).select("start_fn", "sql_write", "redis_read")


@query(_IO_SQL + " select start_fn, string_agg(distinct file || ':' || line, ', ' order by file || ':' || line) as refs from io where n = 1 group by 1")
def file_refs(spark, sf_dir):
    return report.file_refs(_io(spark, sf_dir)).select("start_fn", "refs")


# --- topology ----------------------------------------------------------------------------

_ROUTES_SQL = f"urls as (select distinct {_base('url')} as path, regexp_extract(url, '://([^/]+)', 1) as host from pages), routes as (select path, min(host) as service from urls group by 1 having count(*) = 1)"


def _urls(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select(S.strip_base_url(F.col("url")).alias("path"), F.regexp_extract("url", "://([^/]+)", 1).alias("service")).distinct()


@query(f"with {_ROUTES_SQL} select path, service from routes")
def route_index_unique(spark, sf_dir):
    return topology.route_index(_urls(spark, sf_dir))


_SHORT = "select distinct path || x as path from urls cross join (values ('/extra'), (''), ('?q=1')) as t(x)"


def _asked(spark, sf_dir) -> DataFrame:
    return _urls(spark, sf_dir).select(F.explode(F.transform(F.array(F.lit("/extra"), F.lit(""), F.lit("?q=1")), lambda x: F.concat("path", x))).alias("path")).distinct()


@query(f"with {_ROUTES_SQL}, asked as ({_SHORT}) select a.path, arg_max(r.service, length(r.path)) as service from asked a join routes r on starts_with(a.path, r.path) and length(r.path) > 1 group by 1")
def longest_prefix_match(spark, sf_dir):
    return topology.longest_prefix(_asked(spark, sf_dir), topology.route_index(_urls(spark, sf_dir)))


_REAL = "real as (select distinct string_split(path, '/')[2] as service from urls where string_split(path, '/')[2] > 'm')"
_RESOLVED = f"""{_ROUTES_SQL}, {_REAL}, asked as ({_SHORT}), p as (select a.path, arg_max(r.service, length(r.path)) as service from asked a join routes r on starts_with(a.path, r.path) and length(r.path) > 1 group by 1),
resolved as (select a.path, coalesce(r.service, s.service, p.service) as service from asked a left join routes r using (path) left join real s on s.service = string_split(a.path, '/')[2] left join p on p.path = a.path where coalesce(r.service, s.service, p.service) is not null)"""


def _resolved(spark, sf_dir) -> DataFrame:
    urls = _urls(spark, sf_dir)
    real = urls.select(F.split_part("path", F.lit("/"), F.lit(2)).alias("service")).where("service > 'm'").distinct()
    return topology.resolve_paths(_asked(spark, sf_dir), topology.route_index(urls), real)


@query(f"with {_RESOLVED} select path, service from resolved")
def resolve_http_path(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(f"with {_RESOLVED}, pg as (select {_base('url')} as path, 'svc' || length(url) as src from pages) select distinct src, service as dst, 'http' as medium, path as key from pg join resolved using (path) where src <> service")
def topology_http(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select(F.lit("http_out").alias("medium"), F.col("url").alias("file"), S.strip_base_url(F.col("url")).alias("key_raw"), F.concat(F.lit("svc"), F.length("url")).alias("service"))
    return topology.topology_http(pages.drop("service"), pages.select("file", "service").distinct(), _resolved(spark, sf_dir))


_LINK_SQL = f"""{V.FACTS_SQL}, f as (select 'u' || user_id as file, 'svc' || (user_id % 20) as service, event_type || (cast(floor(value) as int) % 40) as key_raw from events where event_type in ('error', 'view')),
firsts as (select key_raw, service as dst, min(file) as file from f group by all),
links as (select a.service as src, arg_min(b.dst, b.file) as dst, 'kafka' as medium, a.key_raw as key from (select distinct service, key_raw from f where starts_with(key_raw, 'error')) a join firsts b on a.key_raw = b.key_raw and a.service <> b.dst group by a.service, a.key_raw)"""


def _links(spark, sf_dir) -> DataFrame:
    e = V.table(spark, sf_dir, "events").where("event_type in ('error', 'view')")
    rows = e.select(F.concat(F.lit("u"), "user_id").alias("file"), F.concat(F.lit("svc"), F.col("user_id") % 20).alias("service"), F.concat("event_type", (F.floor("value").cast("int") % 40).cast("string")).alias("key_raw"), F.when(F.col("event_type") == "error", F.lit("kafka")).otherwise(F.lit("redis")).alias("medium"))
    homes = rows.select("file", "service").distinct()
    symbols = rows.select("file", F.lit("x").alias("name"), F.lit("function").alias("kind")).limit(0)
    return topology.topology_keys(rows.drop("service"), symbols, homes, homes)


@query(f"with {_LINK_SQL} select src, dst, medium, key from links")
def topology_key_match(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"""with {_LINK_SQL}, k as (select src, dst, medium, string_agg(distinct key, ', ' order by key) as keys from links group by all)
select src, dst, '  ' || rpad(src, cast(greatest(20, length(src)) as int), ' ') || ' →  ' || rpad(dst, cast(greatest(20, length(dst)) as int), ' ') || ' ' || string_agg(medium || ': ' || keys, '  ' order by medium) as line from k group by src, dst""")
def topology_report(spark, sf_dir):
    return report.topology_lines(_links(spark, sf_dir))


@query("select c_custkey, case when c_acctbal < 0 then 'Background' when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then '[auth: Auth' || c_mktsegment || ']' else 'Public' end as bucket from customer")
def auth_bucket(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    middleware = F.array(F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.concat(F.lit("Auth"), "c_mktsegment")).otherwise(F.lit("log")))
    return c.select("c_custkey", S.auth_bucket(F.when(F.col("c_acctbal") >= 0, F.lit("/x")), middleware).alias("bucket"))


@query()
def service_entries(spark, sf_dir):
    """Entry points of the source files, by service."""
    return index(V.src_files(spark, sf_dir))["entries"].select("service", "file", "fn_name", "kind", "path", "method", "confidence")


@query()
def report_lines(spark, sf_dir):
    """The report of the source files, a row for each line."""
    return index(V.src_files(spark, sf_dir), Config())["report"]


def _entry_line(where: str, label: str, keys: str, refs: str | None = None) -> str:
    shown = f"string_agg(distinct {keys}, ', ' order by {keys}) filter (where {where})"
    tail = f" || coalesce('  [' || string_agg(distinct {refs}, ', ' order by {refs}) filter (where {where} and not regexp_matches({refs}, '/test|/spec|_test\\.|_spec\\.') and not starts_with({refs}, 'customers')) || ']', '')" if refs else ""
    return f"'{label}' || {shown}{tail}"


_IO_SQL = f"""{V.FACTS_SQL}, io as (select fn_name, medium, direction, key_raw, key_norm, event_type, case when event_type = 'view' then 'customers' when event_type = 'click' then 'app/tests/click' else 'app/' || event_type end || ':' || line as ref
  from facts join events on event_id = line), lines as (select fn_name, [{", ".join(_entry_line(f"medium = '{m}' and direction = '{d}'", f"  {m}:  {d}s ", "key_norm", "ref") for m, d in report.REPORTED)}] as lines from io group by fn_name),
e as (select 'c' || c_custkey as fn_name, c_custkey as line, 'svc' || c_nationkey as service, case when c_acctbal >= 0 then '/c/' || c_custkey end as path, case when c_acctbal < 0 then 'Background' when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then '[auth: Auth' || c_mktsegment || ']' else 'Public' end as bucket from customer)"""


@query(f"""with {_IO_SQL}, shown as (select service, bucket, list_concat([coalesce('GET ' || path, fn_name), '  file: customers:' || line], coalesce(list_filter(lines, lambda x: x is not null), [])) as told from e left join lines using (fn_name))
select service as section, unnest(told) as line from shown union all select distinct service, '### ' || bucket from e union all select service, '' from (select distinct service, bucket from e) union all select distinct service, unnest(['## ' || service || ' [?]', '']) from e
union all select '', unnest(['# Codemap — shop', 'Generated: 2024-01-01 | Files: 1 | Languages: sql', ''])""")
def report_entries(spark, sf_dir):
    """Customers as entry points with their events, as lines of a report."""
    c, none = V.table(spark, sf_dir, "customer"), F.lit(None).cast("string")
    path = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("/c/"), "c_custkey"))
    middleware = F.array(F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.concat(F.lit("Auth"), "c_mktsegment")).otherwise(F.lit("log")))
    entries = c.select(F.concat(F.lit("c"), "c_custkey").alias("fn_name"), F.lit("customers").alias("file"), F.col("c_custkey").cast("long").alias("line"), F.concat(F.lit("svc"), "c_nationkey").alias("service"), path.alias("path"), F.when(path.isNotNull(), F.lit("GET")).alias("method"), middleware.alias("middleware"))
    facts = V.facts(spark, sf_dir)
    file = F.when(F.col("key_raw") == "view", F.lit("/r/customers")).when(F.col("key_raw") == "click", F.lit("/r/app/tests/click")).otherwise(F.concat(F.lit("/r/app/"), "key_raw"))
    io = facts.select(F.col("fn_name").alias("start_fn"), F.lit("customers").alias("start_file"), file.alias("file"), "line", "medium", "direction", "key_raw", "key_norm")
    files = spark.range(1).select(F.lit("customers").alias("file"), F.lit("sql").alias("language"))
    links = spark.createDataFrame([], "src string, dst string, medium string, key string")
    return report.report_lines(entries, io, links, "shop", "2024-01-01", files, "/r/").select("section", "line")


# --- more questions ----------------------------------------------------------------------


@query(f"with {V.FACTS_SQL} select medium, direction, count(*) as events, count(distinct fn_name) as functions, cast(sum(case when prov_confidence < 0.7 then 1 else 0 end) as bigint) as unsure from facts group by all")
def fact_stats(spark, sf_dir):
    f = V.facts(spark, sf_dir)
    return f.groupBy("medium", "direction").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("fn_name").alias("functions"), F.count_if(F.col("prov_confidence") < 0.7).alias("unsure"))


@query(f"with {V.FACTS_SQL} select fn_name, line, medium from facts where prov_confidence < 0.7")
def lowconf(spark, sf_dir):
    return explore.lowconf(V.facts(spark, sf_dir)).select("fn_name", "line", "medium")


@query(f"with {V.FACTS_SQL} select key_norm, count(distinct fn_name) as functions from facts group by 1 having count(distinct fn_name) > 1")
def cross_key(spark, sf_dir):
    return explore.cross(V.facts(spark, sf_dir))


def _touches(spark, sf_dir) -> DataFrame:
    """Events of orders: a customer's orders write its row, suppliers' lines read their order."""
    o = V.table(spark, sf_dir, "orders")
    none = lambda medium, direction, fn, file, key, c: [F.concat(F.lit(fn[0]), fn[1]).alias("fn_name"), F.lit(file).alias("file"), F.lit(medium).alias("medium"), F.lit(direction).alias("direction"), key.alias("key_norm"), c.alias("prov_confidence")]
    c = F.when(F.col("o_orderstatus") == "P", F.lit(0.4)).otherwise(F.lit(0.9))
    writes = o.select(*none("sql", "write", ("o", "o_orderkey"), "orders", F.concat(F.lit("c"), "o_custkey"), c))
    reads = V.table(spark, sf_dir, "customer").select(*none("sql", "read", ("n", "c_nationkey"), "nations", F.concat(F.lit("c"), "c_custkey"), F.lit(0.65)))
    return writes.unionByName(reads)


_TOUCHES_SQL = """touches as (select 'o' || o_orderkey as fn_name, 'orders' as file, 'sql' as medium, 'write' as direction, 'c' || o_custkey as key_norm, case when o_orderstatus = 'P' then 0.4 else 0.9 end::double as prov_confidence from orders
  union all select 'n' || c_nationkey, 'nations', 'sql', 'read', 'c' || c_custkey, 0.65 from customer)"""
_FLOWS_SQL = "w.fn_name as writer, w.file as writer_file, r.fn_name as reader, r.file as reader_file, w.medium, w.key_norm, least(w.prov_confidence, r.prov_confidence) as confidence from touches w join touches r using (medium, key_norm) where w.direction = 'write' and r.direction = 'read' and w.prov_confidence >= 0.5 and r.prov_confidence >= 0.5"


@query(f"with {_TOUCHES_SQL} select distinct {_FLOWS_SQL}")
def stitch_boundary_flows(spark, sf_dir):
    """Orders write what nations read."""
    return explore.boundary_flows(_touches(spark, sf_dir))


@query(f"""with {_TOUCHES_SQL}, f as (select distinct {_FLOWS_SQL})
select distinct 'sql:' || key_norm as src_fn, null as src_file, fn_name as dst_fn, file as dst_file, 'reads' as rel from touches where direction = 'read'
union all select distinct fn_name, file, 'sql:' || key_norm, null, 'writes' from touches where direction = 'write'
union all select distinct writer, writer_file, reader, reader_file, 'data_flow' from f""")
def data_flow(spark, sf_dir):
    return explore.data_flow(_touches(spark, sf_dir))


@query(f"with {_TOUCHES_SQL} select medium, key_norm, string_agg(distinct fn_name, ',' order by fn_name) as functions from touches group by all")
def carriers(spark, sf_dir):
    return explore.carriers(_touches(spark, sf_dir))


@query(f"with {V.SRC_SQL}, e as (" + " union all ".join(f"select file, unnest(regexp_extract_all(text, {text(p)}, 1)) as module from lines where language in {words(langs)}" for langs, p in R.IMPORT_RULES) + ") select module, count(distinct file) as files from e group by 1")
def rdeps(spark, sf_dir):
    return explore.rdeps(extract.edges(V.src_files(spark, sf_dir)))


@query(f"with {V.SRC_SQL}, e as (" + " union all ".join(f"select file, unnest(regexp_extract_all(text, {text(p)}, 1)) as module from lines where language in {words(langs)}" for langs, p in R.IMPORT_RULES) + ") select distinct file, module from e")
def deps(spark, sf_dir):
    return explore.deps(extract.edges(V.src_files(spark, sf_dir)))


@query("select 'o' || o_orderkey as start_fn, 'r' || n_regionkey as fn, array_to_string(['o' || o_orderkey, 'c' || o_custkey, 'n' || c_nationkey, 'r' || n_regionkey], ' ') as path from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey")
def call_path(spark, sf_dir):
    starts = V.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("fn"), F.lit("orders").alias("file"))
    goals = V.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("fn"), F.lit("regions").alias("file"))
    found = explore.call_path(starts, goals, V.calls(spark, sf_dir), 3)
    return found.select("start_fn", "fn", F.array_join("path", " ").alias("path"))


@query("select 'c' || c_custkey as name, c_mktsegment as file from customer where regexp_matches('c' || c_custkey, '^c[0-9]*7$')")
def search(spark, sf_dir):
    symbols = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_mktsegment").alias("file"))
    return explore.search(symbols, "^c[0-9]*7$")


@query("select 'c' || c_custkey as name, c_mktsegment as file from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def lookup(spark, sf_dir):
    symbols = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_mktsegment").alias("file"))
    return explore.lookup(symbols, V.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("name")))


@query(f"with {V.FACTS_SQL} select fn_name, file, medium, count(*) as events from facts group by all")
def boundaries(spark, sf_dir):
    return explore.boundaries(V.facts(spark, sf_dir))


@query(_reach_sql(6) + ", t as (select 'c' || c_custkey as fn, 'sql' as medium from customer union all select 'n' || n_nationkey, 'env' from nation) select start_fn, count(distinct fn) as span_count, coalesce(string_agg(distinct medium, ',' order by medium), '') as media from r left join t using (fn) group by 1")
def trace_stats(spark, sf_dir):
    made = lambda t, fn, file, medium: V.table(spark, sf_dir, t).select(fn.alias("fn_name"), F.lit(file).alias("file"), F.lit(medium).alias("medium"), F.lit(0.9).alias("prov_confidence"))
    events = made("customer", F.concat(F.lit("c"), "c_custkey"), "customers", "sql").unionByName(made("nation", F.concat(F.lit("n"), "n_nationkey"), "nations", "env"))
    return explore.trace_stats(_reached(spark, sf_dir, 6), events).select("start_fn", "span_count", "media")


@query("select 'c' || c_custkey as start_fn, unnest(['c' || c_custkey, 'c' || c_custkey || ' → n' || c_nationkey, 'n' || c_nationkey || ' → r' || n_regionkey]) as text from customer join nation on n_nationkey = c_nationkey")
def serialize_compact(spark, sf_dir):
    starts = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("fn"), F.lit("customers").alias("file"))
    return explore.serialize(graph.paths(starts, V.calls(spark, sf_dir), 2), "compact").select("start_fn", "text")


@query("select 'c' || c_custkey as start_fn, '    r' || n_regionkey as text, 1::bigint as truncated from customer join nation on n_nationkey = c_nationkey where n_nationkey <> (select min(x.n_nationkey) from nation x where x.n_regionkey = nation.n_regionkey)")
def trace_budget(spark, sf_dir):
    """The third and last span within a budget of three; starts whose path comes round have no more than three."""
    starts = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("fn"), F.lit("customers").alias("file"))
    kept = explore.budgeted(graph.paths(starts, V.calls(spark, sf_dir), 3), 3).where("truncated > 0 and depth = 2")
    return explore.serialize(kept).join(kept.select("start_fn", "truncated"), "start_fn").select("start_fn", "text", "truncated")


def _steps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Steps of a graph with hubs: regions call nations, nations their customers, customers write what their orders read, orders call their customer."""
    o, c, n = (V.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    name = lambda letter, k: F.concat(F.lit(letter), F.col(k).cast("string"))
    part = lambda df, a, fa, b, fb: df.select(a.alias("src_fn"), F.lit(fa).alias("src_file"), b.alias("dst_fn"), F.lit(fb).alias("dst_file"))
    near = part(n, name("r", "n_regionkey"), "regions", name("n", "n_nationkey"), "nations").unionByName(part(c, name("n", "c_nationkey"), "nations", name("c", "c_custkey"), "customers"))
    near = near.unionByName(part(o, name("o", "o_orderkey"), "orders", name("c", "o_custkey"), "customers"))
    file = F.when(F.col("o_orderstatus") == "O", F.lit("orders")).otherwise(F.lit("customers"))
    flows = o.select(name("c", "o_custkey").alias("writer"), F.lit("customers").alias("writer_file"), name("o", "o_orderkey").alias("reader"), file.alias("reader_file"))
    starts = near.select(F.col("src_fn").alias("fn"), F.col("src_file").alias("file")).where("file <> 'orders'").unionByName(flows.select(F.col("writer").alias("fn"), F.col("writer_file").alias("file")))
    return starts.distinct(), graph.trace_steps(near, flows)


_TRACE_BUDGET, _TRACE_DEPTH = 12, 3


def _traces_sql(last: str) -> str:
    hops = ""
    for d in range(1, _TRACE_DEPTH + 1):
        hops += f"""
offer{d} as (select l.*, d.degree, sum(d.degree) over (partition by s) as total, sum(d.degree) over (partition by s order by position) - d.degree as earlier from hop{d - 1} l join degree d using (node) where not again),
hop{d} as (select s, x.dst as node, {d} as depth, (earlier + n)::bigint as position, list_append(path, x.dst) as path, x.kind as kind, list_contains(path, x.dst) as again, greatest(o."left" - total, 0) as "left" from offer{d} o join ranked x using (node) where earlier + n <= o."left"),"""
    return f"""with steps as (
  select distinct * from (select 'r' || n_regionkey || '@regions' as node, 'n' || n_nationkey || '@nations' as dst, 'n' || n_nationkey as fn, 'call' as kind, 0 as rank from nation
  union all select 'n' || c_nationkey || '@nations', 'c' || c_custkey || '@customers', 'c' || c_custkey, 'call', 0 from customer
  union all select 'o' || o_orderkey || '@orders', 'c' || o_custkey || '@customers', 'c' || o_custkey, 'call', 0 from orders
  union all select 'c' || o_custkey || '@customers', 'o' || o_orderkey || case when o_orderstatus = 'O' then '@orders' else '@customers' end, 'o' || o_orderkey, case when o_orderstatus = 'O' then 'boundary_flow' else 'data_flow' end, case when o_orderstatus = 'O' then 2 else 1 end from orders)),
degree as (select node, count(*) as degree from steps group by node),
ranked as (select *, row_number() over (partition by node order by rank, fn, dst) as n from steps),
hop0 as (select distinct node as s, node, 0 as depth, 1::bigint as position, [node] as path, null::varchar as kind, false as again, {_TRACE_BUDGET}::bigint as "left" from steps where not ends_with(node, '@orders')),{hops}
{last}"""


@query(_traces_sql("spans as (" + " union all ".join(f"select * from hop{d}" for d in range(_TRACE_DEPTH + 1)) + ") select split_part(s, '@', 1) as start_fn, depth, position, array_to_string(path, '/') as path, kind, again from spans"))
def trace_spans(spark, sf_dir):
    """Calls and flows from every region, nation and customer within a budget of spans."""
    spans, _ = graph.traces(*_steps(spark, sf_dir), _TRACE_BUDGET, _TRACE_DEPTH)
    return spans.select("start_fn", "depth", "position", F.array_join("path", "/").alias("path"), "kind", "again")


@query(_traces_sql("cuts as (" + " union all ".join(f'select s, greatest(max(total) - max("left"), 0) as cut from offer{d} group by s' for d in range(1, _TRACE_DEPTH + 1)) + ") select split_part(h.s, '@', 1) as start_fn, coalesce(sum(cut), 0)::bigint as truncated from hop0 h left join cuts using (s) group by h.s"))
def trace_cuts(spark, sf_dir):
    """How many steps the budget left out."""
    _, cuts = graph.traces(*_steps(spark, sf_dir), _TRACE_BUDGET, _TRACE_DEPTH)
    return cuts.select("start_fn", "truncated")


@query(f"with {V.SRC_SQL} select file, regexp_extract(file, '^(svc[0-9]+)/', 1) || case when language = 'python' then '/src' else '' end as root from src_files where language in ('javascript', 'python')")
def workspace_root(spark, sf_dir):
    files = V.src_files(spark, sf_dir)
    top, src = F.split_part("file", F.lit("/"), F.lit(1)), F.concat(F.split_part("file", F.lit("/"), F.lit(1)), F.lit("/src"))
    made = [files.select(top.alias("folder"), F.lit("package.json").alias("name")), files.select(top.alias("folder"), F.lit("setup.py").alias("name")), files.select(src.alias("folder"), F.lit("pyproject.toml").alias("name"))]
    return explore.workspace_roots(files.where("language not in ('typescript')"), made[0].unionByName(made[1]).unionByName(made[2]))


@query("select distinct 's' || l_suppkey as src_symbol, 'f' || (l_suppkey % 7) as src_file, 'p' || (l_partkey % 100) as dst_symbol, case when l_partkey % 2 = 0 then 'at' || (l_partkey % 100) end as dst_file from lineitem")
def resolve_edges(spark, sf_dir):
    """Calls of suppliers to hundreds of parts; of even ones the target is told."""
    edges = V.table(spark, sf_dir, "lineitem").select(
        F.lit("calls").alias("rel"), F.concat(F.lit("s"), "l_suppkey").alias("src_symbol"), F.concat(F.lit("f"), F.col("l_suppkey") % 7).alias("src_file"),
        F.concat(F.lit("p"), F.col("l_partkey") % 100).alias("dst_symbol"), F.lit(None).cast("string").alias("dst_file"), F.lit(1).cast("long").alias("line"),
    ).distinct()
    told = edges.where("substring(dst_symbol, 2) % 2 = 0").select("src_file", "line", "dst_symbol", F.concat(F.lit("at"), F.substring("dst_symbol", 2, 9)).alias("dst_file"))
    return explore.resolve_edges(edges, told).select("src_symbol", "src_file", "dst_symbol", "dst_file")


@query(f"""with {V.SRC_SQL}, {_stated('line, name', _CALLED_ROWS)}, asked as (select file, line, language, {_filled('name')} as name from stated)
select file as src_file, cast(line as bigint) as line, name as dst_symbol, case when a.language in ('javascript', 'typescript', 'python', 'rust') then a.language else regexp_extract(file, '[.]([a-z]+)$', 1) end as language,
  strlen(regexp_extract(text, '^(.*?)\\b' || name || '\\b', 1)) as \"column\" from asked a join lines using (file, line)""")
def resolution_requests(spark, sf_dir):
    """Every call of the sources: none has a known target yet."""
    files, none = V.src_files(spark, sf_dir), F.lit(None).cast("string")
    calls = extract.calls(files).select(F.lit("calls").alias("rel"), "src_file", "line", "dst_symbol", none.alias("dst_file"))
    return explore.resolution_requests(calls, files).withColumn("column", F.col("column").cast("long"))


@query("select c_custkey, case when c_custkey % 4 < 2 then 6 + 2 * (c_custkey % 4) else -1 end::bigint as at from customer")
def receiver_column(spark, sf_dir):
    lines = F.array(F.lit("  x = cache.get('a')"), F.lit("éé  y = db.query(q)"), F.lit("query(q)"), F.lit("no call"))
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.get(lines, (F.col("c_custkey") % 4).cast("int")).alias("line"))
    medium = F.when(F.col("c_custkey") % 4 == 0, F.lit("redis")).otherwise(F.lit("sql"))
    at = S.receiver_column(F.col("line"), medium)
    return c.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 4 == 1, at - 2).otherwise(at), F.lit(-1)).cast("long").alias("at"))


@query("select c_custkey, 'file:///' || case when c_custkey % 2 = 0 then 'abs/' else 'root/rel/' end || c_name as uri, case when c_custkey % 2 = 0 then '/abs/' else '/root/rel/' end || c_name as path, ['root', 'call', 'data_flow', 'boundary_flow'][c_custkey % 4 + 1] as kind from customer")
def uri_and_kind(spark, sf_dir):
    path = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/abs/"), "c_name")).otherwise(F.concat(F.lit("rel/"), "c_name"))
    kind = F.get(F.array(*map(F.lit, R.EDGE_KINDS)), (F.col("c_custkey") % 4).cast("int"))
    rows = V.table(spark, sf_dir, "customer").select("c_custkey", S.path_to_uri(path, "/root").alias("uri"), S.edge_kind(kind).alias("kind"))
    return rows.select("c_custkey", "uri", S.uri_to_path(F.col("uri")).alias("path"), "kind")


@query("select doc_id as fn_name, lang is distinct from 'es' and lang is distinct from 'de' as ok, case when lang = 'es' then 'unparseable JSON' when lang = 'de' then 'missing field: purpose' end as problem, case when lang is distinct from 'es' and lang is distinct from 'de' then 'does ' || doc_id end as purpose from documents")
def annotation_validator(spark, sf_dir):
    """Annotations by language: German ones have no purpose, Spanish ones aren't JSON."""
    good = F.concat(F.lit('{"purpose": "does '), F.col("doc_id").cast("string"), F.lit('", "value_names": ["◆ok", "bad"]}'))
    raw = F.when(F.col("lang") == "es", F.lit("{oops")).when(F.col("lang") == "de", F.lit('{"value_names": []}')).otherwise(good)
    return explore.validated(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fn_name"), raw.alias("raw"))).select("fn_name", "ok", "problem", "purpose")


@query("select doc_id as fn_name from documents where lang = 'en' and source <> 'src3'")
def functions_to_annotate(spark, sf_dir):
    """English texts are new; those of one source are done, other languages have annotations."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fn_name"), F.col("source").alias("file"), F.concat("text", F.col("doc_id").cast("string")).alias("source"), "lang")
    had = docs.where("lang is distinct from 'en'").select(F.sha2("source", 256).alias("source_hash"))
    done = docs.where("file = 'src3'").select(F.lit("annotate").alias("step"), F.sha2("source", 256).alias("key"), F.lit("failed").alias("status"))
    checks = explore.checkpoint_statuses(done, done.withColumn("status", F.lit("done")))
    return explore.to_annotate(docs, had, checks).select("fn_name")


@query(_reach_sql(6) + " select fn, count(*) as traces, min(depth) as nearest from r group by 1")
def traces_touching(spark, sf_dir):
    return _reached(spark, sf_dir, 6).groupBy("fn").agg(F.count(F.lit(1)).alias("traces"), F.min("depth").alias("nearest"))


@query(_reach_sql(3) + f", {V.FACTS_SQL} select medium, key_norm, count(distinct start_fn) as traces from r join (select distinct fn_name, medium, key_norm from facts) f on f.fn_name = r.fn and r.file = 'customers' group by all")
def traces_by_key(spark, sf_dir):
    """How many orders' traces reach each key of the customers' events."""
    return explore.traces_touching(_reached(spark, sf_dir, 3), V.facts(spark, sf_dir))


@query(_reach_sql(2) + " select distinct start_fn, 'orders' as start_file from r join (select 'customers' as file from customer where c_custkey % 2 = 0 limit 1) using (file)")
def changed_roots(spark, sf_dir):
    """The traces to build again when the customers' file has changed."""
    changed = V.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lit("customers").alias("file"))
    return explore.changed_roots(_reached(spark, sf_dir, 2), changed)


@query(f"""with {V.CALLS_SQL}, {V.FACTS_SQL} select 'c' || c_custkey as fn, 'customers' as file, '0' as position, 'FN  c' || c_custkey || '  customers:' || c_custkey as text from customer
union select fn_name, file, '1' || lpad(line::varchar, 9, '0'), rpad(upper(direction), 8, ' ') || medium || '["' || key_norm || '"]' || case when prov_confidence < 0.7 then ' ?' else '' end from facts
union select src_fn, src_file, '2' || dst_fn, 'CALL    ' || dst_fn || '()' from calls""")
def skeleton(spark, sf_dir):
    """Customers as functions: their line, their events, their calls."""
    symbols = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.lit("customers").alias("file"), F.col("c_custkey").cast("long").alias("line"), F.lit("function").alias("kind"))
    return explore.skeleton(symbols, V.calls(spark, sf_dir), V.facts(spark, sf_dir))


@query("""with p as (select 'c' || o_custkey as fn_name, 'customers' as file, case o_orderstatus when 'F' then 0.9 when 'O' then 0.7 else 0.5 end as confidence, 'order_' || lower(o_orderstatus) as h from orders
  union all select 'c' || user_id, 'customers', 0.9, 'consumer' from events where event_type = 'error'
  union all select case n_nationkey % 4 when 0 then 'main' when 1 then 'serve' else 'n' || n_nationkey end, 'nation' || n_nationkey, 0.8, 'main_name' from nation where n_nationkey % 4 < 2)
select fn_name, file, max(confidence)::double as confidence, array_to_string(list_sort(list(distinct h)), ',') as heuristics from p group by all having max(confidence) >= 0.6""")
def five_heuristics(spark, sf_dir):
    """Customers with orders as detected entry points, those with errors as consumers, some nations as programs."""
    o, n = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "nation")
    confidence = F.when(F.col("o_orderstatus") == "F", F.lit(0.9)).when(F.col("o_orderstatus") == "O", F.lit(0.7)).otherwise(F.lit(0.5))
    points = o.select(F.concat(F.lit("c"), "o_custkey").alias("fn_name"), F.lit("customers").alias("file"), confidence.alias("confidence"), F.array(F.concat(F.lit("order_"), F.lower("o_orderstatus"))).alias("heuristics"))
    events = V.facts(spark, sf_dir).withColumn("direction", F.when(F.col("medium") == "kafka", F.lit("read")).otherwise(F.lit("write")))
    of = F.col("n_nationkey") % 4
    name = F.when(of == 0, F.lit("main")).when(of == 1, F.lit("serve")).otherwise(F.concat(F.lit("n"), "n_nationkey"))
    symbols = n.select(name.alias("name"), F.concat(F.lit("nation"), "n_nationkey").alias("file"), F.lit("function").alias("kind"))
    return explore.five_heuristics(points, events, symbols).withColumn("heuristics", F.array_join("heuristics", ","))


@query("""with f as (select user_id, event_type, min(event_id) as first from events group by all)
select user_id, event_type, '$v' || dense_rank() over (partition by user_id order by first) as name from f""")
def baggage_names(spark, sf_dir):
    f = V.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return explore.baggage_names(f, "user_id", "first").select("user_id", "event_type", "name")


@query("""with q as (select embedding::double[] as q from embeddings where vec_id = 0), s as (select vec_id, list_dot_product(embedding::double[], q) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::double[], embedding::double[])) as score from embeddings, q)
select vec_id, round(score, 9) as score from s order by score desc, vec_id limit 10""")
def vector_topk(spark, sf_dir):
    """The ten vectors nearest to vector 0 by cosine (a top-k report)."""
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return explore.nearest_vectors(e, e.where("vec_id = 0").first()["v"])


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], '|') as lines from documents")
def source_window(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", explore.source_window(docs, 2, 3, "text").alias("lines"))