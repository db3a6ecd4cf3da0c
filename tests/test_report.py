"""The report's text, byte for byte."""

from factweave.operators import report

REPORT = """\
# Codemap — shop
Generated: 2024-05-06 | Files: 3 | Languages: go, python

## Service Topology
  a                    →  b                    kafka: x, y  redis: k
  a-very-long-service-name →  b                    http: /p

## a [python]

### Public
GET /a
  file: a/x.py:3
  in:   body{Order}, body{User}, headers{X-A, x-b}
  sql:  reads t, u  [a/db.py:7, b/db.py:9]
  sql:  writes t
  redis:  reads k
  kafka:  writes out  [a/q.py:1]

POST /a
  file: a/x.py:9

### [auth: auth, admin_only]
GET /z
  file: a/y.go

### Background
job
  file: a/x.py:1

## b [go]

### Background
run
  file: b/m.go:2

"""


def test_report_is_equal_to_the_text(spark):
    entry = "fn_name string, file string, line long, service string, path string, method string, middleware array<string>"
    entries = spark.createDataFrame([
        ("f", "/r/a/x.py", 3, "a", "/a", "GET", ["log"]), ("g", "/r/a/x.py", 9, "a", "/a", "POST", []), ("z", "/r/a/y.go", None, "a", "/z", "GET", ["auth", "log", "admin_only"]),
        ("job", "/r/a/x.py", 1, "a", None, None, ["auth"]), ("run", "/r/b/m.go", 2, "b", None, "GET", [])], entry)
    io = spark.createDataFrame([
        ("f", "/r/a/x.py", *x) for x in (
            ("/r/a/db.py", 7, "sql", "read", "q", "t"), ("/r/b/db.py", 9, "sql", "read", "q", "u"), ("/r/a/x.py", 4, "sql", "read", "q", "u"), ("/r/a/test/db.py", 1, "sql", "write", "q", "t"), ("/r/a/db_spec.py", 2, "redis", "read", "k", "k"),
            ("/r/a/q.py", 1, "kafka", "write", "out", "out"), ("/r/a/q.py", 1, "grpc", "read", "User", "User"), ("/r/a/q.py", 2, "grpc", "read", "Order", "Order"), ("/r/a/q.py", 3, "http_header", "read", "x-b", "x-b"),
            ("/r/a/q.py", 4, "http_header", "read", "X-A", "X-A"), ("/r/a/q.py", 4, "http_header", "write", "X-C", "X-C"), ("/r/a/q.py", 4, "env", "read", "E", "E"))],
        "start_fn string, start_file string, file string, line long, medium string, direction string, key_raw string, key_norm string")
    links = spark.createDataFrame([("a", "b", "kafka", "y"), ("a", "b", "kafka", "x"), ("a", "b", "kafka", "x"), ("a", "b", "redis", "k"), ("a-very-long-service-name", "b", "http", "/p")], "src string, dst string, medium string, key string")
    files = spark.createDataFrame([("1", "python"), ("2", "go"), ("3", "go")], "file string, language string")
    rows = report.report_lines(entries, io, links, "shop", "2024-05-06", files, "/r/").orderBy("section", "part", "position").collect()
    want = REPORT.replace("\n\nPOST /a", "\nPOST /a")  # entries of a bucket follow each other
    assert "".join(r.line + "\n" for r in rows) == want


def test_empty_report(spark):
    entries = spark.createDataFrame([], "fn_name string, file string, line long, service string, path string, method string, middleware array<string>")
    io = spark.createDataFrame([], "start_fn string, start_file string, file string, line long, medium string, direction string, key_raw string, key_norm string")
    links = spark.createDataFrame([], "src string, dst string, medium string, key string")
    rows = report.report_lines(entries, io, links, "p", "d").orderBy("section", "part", "position").collect()
    assert [r.line for r in rows] == ["# Codemap — p", "Generated: d | Files: 0 | Languages: ", ""]
