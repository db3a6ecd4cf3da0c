"""Facts, graph and report on a small source tree of several services."""

import pytest
from pyspark.sql import functions as F

from factweave.functions import scalars as S
from factweave.operators import explore, extract, graph
from factweave.plans.index import Config, index
from factweave.queries import QUERIES
from factweave.sources.files import list_files, read_tree, snapshot_status

TREE = {
    "service_a/index.js": """const express = require('express');
const app = express();

function createOrder(req, res) {
  res.setHeader('X-User-Id', req.user.id);
  producer.send({ topic: 'user.events', messages: [req.body] });
  redis.set(`session:${req.user.id}`, token);
  res.json({ ok: true });
}

app.post('/orders', createOrder);
""",
    "service_b/handler.go": """package main

func HandleOrder(w http.ResponseWriter, r *http.Request) {
	uid := r.Header.Get("X-User-Id")
	rows := db.Query("SELECT id FROM users")
	_, _ = uid, rows
}

func main() {
	http.HandleFunc("/orders/handle", HandleOrder)
}
""",
    "service_c/consumer.py": """def consume():
    consumer.subscribe(['user.events'])
    session.add(User)
    db.execute("INSERT INTO users VALUES (1)")

@app.get("/health")
def health():
    return cache.get("health:last")
""",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, src in TREE.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(src)
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("redis.get('no')")
    (root / "service_c/__init__.py").write_text("")
    (root / "service_c/notes.txt").write_text("")
    assert sorted(list_files(str(root))) == sorted([*TREE, "service_c/__init__.py"])
    return index(read_tree(spark, str(root)))


def test_events(tables):
    got = {(r.file, r.line, r.fn_name, r.medium, r.direction, r.key_norm, r.prov_confidence) for r in tables["events"].collect()}
    assert got == {
        ("service_a/index.js", 5, "createOrder", "http_header", "write", "X-User-Id", 0.65),
        ("service_a/index.js", 6, "createOrder", "kafka", "write", "user.events", 0.65),
        ("service_a/index.js", 7, "createOrder", "redis", "write", "session:{}", 0.65),
        ("service_b/handler.go", 5, "HandleOrder", "sql", "read", "users", 0.90),
        ("service_c/consumer.py", 2, "consume", "kafka", "read", "user.events", 0.65),
        ("service_c/consumer.py", 3, "consume", "sql", "write", "User", 0.65),
        ("service_c/consumer.py", 4, "consume", "sql", "write", "users", 0.65),
        ("service_c/consumer.py", 8, "health", "redis", "read", "health:last", 0.90),
    }


def test_entries_and_topology(tables):
    got = {(r.fn_name, r.path, r.method, r.framework, r.confidence, r.line) for r in tables["entries"].collect()}
    assert got == {
        ("createOrder", "/orders", "POST", "express", 0.90, 11),
        ("HandleOrder", "/orders/handle", None, "net/http", 0.90, 3),
        ("consume", None, None, None, 0.70, 1),
        ("health", "/health", "GET", "fastapi/flask", 0.90, 7),
    }
    assert {tuple(r) for r in tables["topology"].collect()} == {("service_a", "service_c", "kafka", "user.events"), ("service_c", "service_a", "kafka", "user.events")}
    lines = [r.line for r in tables["report"].orderBy("section", "part", "position").collect()]
    assert lines[lines.index("### Public") :][:2] == ["### Public", "POST /orders"] and any(x.startswith("  sql:  writes User, users") for x in lines) and "consume" in lines and "### Background" in lines


def test_compat_keeps_the_first_table_of_a_query(spark):
    files = spark.createDataFrame([("a/x.py", "python", "def f():\n    db.query('SELECT a FROM t JOIN u')\n")], "file string, language string, src string")
    keys = lambda c: sorted(r.key_norm for r in index(files, Config(compat=c))["events"].collect())
    assert keys(False) == ["t", "u"] and keys(True) == ["t"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (S.normalise_key, "session:{userId}", "session:{}"), (S.normalise_key, "user:${id}", "user:{}"), (S.normalise_key, "session:%d", "session:{}"),
        (S.normalise_key, "k%(x)s", "k{}"), (S.normalise_key, "a + b", "a{}"), (S.strip_base_url, "https://api.example.com/foo/bar", "/foo/bar"),
        (S.strip_base_url, "https://api.example.com", ""), (S.strip_base_url, "/x", "/x"), (S.template_path, "/users/${id}/comments/${cid}", "/users/:param/comments/:param"),
        (S.sql_primary_table, "SELECT id FROM users WHERE x", "users"), (S.sql_primary_table, "INSERT INTO pacts (a)", "pacts"), (S.sql_primary_table, "UPDATE t SET", "t"),
        (S.sql_tables, "SELECT a FROM t JOIN u", ["t", "u"]), (S.sql_tables, "INSERT INTO T1", ["t1"]), (S.sql_verb, "WITH x", "read"), (S.sql_verb, "MERGE", "write"),
        (S.service_from_path, "/home/user/project/service/src/main.rs", "service"), (S.service_from_path, "./core-x/src/lib.rs", "core-x"), (S.service_from_path, "main.rs", "root"),
        (S.service_from_path, "p/svc/static/app.js", "svc"), (S.camel_to_snake, "UserProfilesController", "user_profiles"), (S.header_medium, "Authorization", "http_header"),
        (S.header_medium, "x-timezone", "http_header"), (S.header_medium, "user:1", "redis"),
    ],
)
def test_scalars(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(f(F.col("x")).alias("y")).first()["y"] == want


@pytest.mark.parametrize(
    ("calls", "depth", "want"),
    [
        ("a1b2 b2c3 c3d4", 2, {"a": 0, "b": 1, "c": 2}),
        ("a1b2 b2a1", 6, {"a": 0, "b": 1}),
        ("a1b2 a1c3 b2d4 c3d4", 6, {"a": 0, "b": 1, "c": 1, "d": 2}),
        ("a1b2 b2c3 c3x4 x4y5 a1x4", 3, {"a": 0, "b": 1, "c": 2, "x": 1, "y": 2}),
    ],
)
def test_reach(spark, calls, depth, want):
    near = spark.createDataFrame([tuple(c) for c in calls.split()], "src_fn string, src_file string, dst_fn string, dst_file string")
    starts = spark.createDataFrame([("a", "1")], "fn string, file string")
    assert {r.fn: r.depth for r in graph.reach(starts, near, depth).collect()} == want


def test_ambiguous_names_are_not_followed(spark):
    edges = spark.createDataFrame([("1", "g", "calls", None, "f", 1)], "src_file string, src_symbol string, rel string, dst_file string, dst_symbol string, line long")
    symbols = lambda *files: spark.createDataFrame([("f", "function", x) for x in files], "name string, kind string, file string")
    found = lambda *files: [r.dst_file for r in graph.adjacency_unique_target(edges, symbols(*files)).collect()]
    assert found("2", "3") == [] and found("1", "2") == ["2"] and found("1") == []


def test_snapshot_and_counts(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, sha256 string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "file string, sha256 string")
    assert {r.file: r.status for r in snapshot_status(files, old).collect()} == {"a": "Unchanged", "b": "Changed", "c": "New"}
    src = spark.createDataFrame([("m.py", "python", "import os\nfrom a import b\ndef f():\n  pass")], "file string, language string, src string")
    assert tuple(extract.file_meta_counts(src).first()) == ("m.py", 4, 1, 3)


def test_stream_of_changed_files(spark, tmp_path):
    from factweave.streaming.incremental import changed_files, run_available

    table, seen = str(tmp_path / "t"), []
    rows = lambda *names: spark.createDataFrame([(n, "python", "x", "h") for n in names], "file string, language string, src string, sha256 string")
    for names in (("a", "b", "a"), ("c",)):
        rows(*names).write.mode("append").parquet(table)
        run_available(changed_files(spark, table), str(tmp_path / "c"), lambda batch, _: seen.append(sorted(r.file for r in batch.collect())))
    assert seen == [["a", "b"], ["c"]]


def test_the_command_writes_a_report_and_a_snapshot(spark, tmp_path, capsys):
    from factweave.plans.index import main

    root = tmp_path / "proj"
    for name, src in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(src)
    args = [str(root), "--out", str(tmp_path / "out.md"), "--date", "2020-01-02", "--snapshot", str(tmp_path / "snap")]
    main(args)
    assert "{'New': 3}" in capsys.readouterr().out
    lines = (tmp_path / "out.md").read_text().splitlines()
    assert lines[:2] == ["# Codemap — proj", "Generated: 2020-01-02 | Files: 3 | Languages: go, javascript, python"]
    assert "## service_a [javascript]" in lines and lines.index("### Public") < lines.index("POST /orders") and "  file: service_a/index.js:11" in lines
    (root / "service_c/consumer.py").write_text("x = 1\n")
    main(args)
    assert "'Changed': 1" in (out := capsys.readouterr().out) and "'Unchanged': 2" in out


def test_references_outside_the_own_file_are_shown(spark):
    files = [("a/h.js", "javascript", "export function h(req) {\n  save(1);\n}\napp.get('/h', h);\n"), ("a/store.js", "javascript", "function save(x) {\n  redis.set(`k:${x}`, 1);\n}\n")]
    tables = index(spark.createDataFrame(files, "file string, language string, src string"))
    lines = {r.line for r in tables["report"].collect()}
    assert "  redis:  writes k:{}  [a/store.js:2]" in lines


def test_resolved_edges_of_lines(spark, tmp_path):
    """Parts are told apart by hundreds; the even ones have a target, repeated lines are one edge."""
    rows = [(9, 102), (9, 102), (9, 2), (9, 205), (14, 7), (14, 8)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in QUERIES["resolve_edges"](spark, str(tmp_path)).collect())
    assert got == [("s14", "f0", "p7", None), ("s14", "f0", "p8", "at8"), ("s9", "f2", "p2", "at2"), ("s9", "f2", "p5", None)]


def test_every_call_is_asked_for(spark):
    """Not only the calls of some names: each call of the sources without a known target has its request."""
    of = lambda name: {(r.src_file, r.line, r.dst_symbol) for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    asked = of("resolution_requests")
    assert asked == of("extract_call_edges") and {"getenv", "query"} < {symbol for *_, symbol in asked}


def test_requests_meet_their_line(spark):
    """Bytes before a call's first whole word in its own line; lines that a file doesn't have give no request."""
    files = spark.createDataFrame([("a.py", "python", "x = 1\né = forget(get(1))\nget(2)")], "file string, language string, src string")
    edges = spark.createDataFrame([("calls", "a.py", 2, "get", None), ("calls", "a.py", 3, "get", None), ("calls", "a.py", 9, "get", None), ("calls", "a.py", 3, "get", "b.py"), ("imports", "a.py", 1, "x", None)],
        "rel string, src_file string, line long, dst_symbol string, dst_file string")
    assert {tuple(r) for r in explore.resolution_requests(edges, files).collect()} == {("a.py", 2, "get", "python", 12), ("a.py", 3, "get", "python", 0)}
