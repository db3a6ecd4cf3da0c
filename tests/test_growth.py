"""What tasks and the driver hold doesn't grow with the tables: plans and dealing."""

from factweave import views as V
from factweave.operators import entrypoints, scopes
from factweave.plans.index import index
from factweave.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scopes_stay_with_their_file(spark, monkeypatch):
    """Sources are dealt once, in bounded shares; symbols need no join with their ends."""
    files = V.scoped_files(spark, DATA)
    want = sorted(map(str, scopes.scopes(files).collect()))
    assert "Join" not in plan(QUERIES["function_scopes"](spark, DATA))
    few = scopes.parts_of(files)
    monkeypatch.setattr(scopes, "TASK_TEXT", 2000)
    assert scopes.parts_of(files) > 4 * few
    assert sorted(map(str, scopes.scopes(files).collect())) == want


def test_attribution_without_joins(spark):
    """Facts meet the functions of their file in shares of bounded text; nothing is broadcast."""
    assert "Join" not in plan(QUERIES["scope_attribution"](spark, DATA))


def test_sources_are_not_broadcast(spark):
    """Requests read a line of each source: the table of texts never goes through the driver."""
    assert "Broadcast" not in plan(QUERIES["resolution_requests"](spark, DATA))


def test_hints_are_read_once(spark):
    """Routes are carried from a written table: the sources aren't searched again for each use."""
    assert "c_custkey" not in plan(QUERIES["route_propagation"](spark, DATA))


def test_index_deals_small_tasks(spark, monkeypatch):
    """While tables are written, shuffles are as wide as the text asks for; afterwards the session is as it was."""
    seen, keys = [], ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.autoBroadcastJoinThreshold")
    now = lambda: [spark.conf.get(k, None) for k in keys]
    detect = entrypoints.detect
    monkeypatch.setattr(entrypoints, "detect", lambda *a: (seen.append(now()), detect(*a))[1])
    monkeypatch.setattr(scopes, "TASK_TEXT", 2000)
    before = now()
    index(V.src_files(spark, DATA))
    assert int(seen[0][0]) > 8 and seen[0][1] == "-1" and now() == before


def test_marks_do_not_copy_each_source(spark):
    """Sources without the mark, all but a few, aren't rewritten for every pattern that they match."""
    from pyspark.sql import functions as F

    from factweave.operators import extract

    found = spark.createDataFrame([("a\x01b\nxax",)], "src string").select(extract.matches(F.col("src"), "a", lambda text, line: F.struct(text, line)).alias("m"))
    assert "translate(" not in found._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in found.first()["m"]] == [("a", 1), ("a", 2)]


def test_sources_are_lexed_once(spark, monkeypatch):
    """All extractors of the index share one table of sources without comments and strings."""
    from factweave.functions import lexer

    lexed, code = [], lexer.code
    monkeypatch.setattr(lexer, "code", lambda *a: (lexed.append(a), code(*a))[1])
    tables = index(spark.createDataFrame([("a/x.py", "python", "def f():\n    db.query('SELECT a FROM t') # 'SELECT a FROM u'\n")], "file string, language string, src string"))
    assert len(lexed) == 1 and [r.key_norm for r in tables["events"].collect()] == ["t"]


def test_events_do_not_split_their_source(spark):
    """A source is split into lines once, not for each of its events, and isn't copied to them."""
    from factweave.operators import extract

    events = extract.boundary_events(spark.createDataFrame([("a.js", "javascript", "x\n  process.env.A_B; process.env.C_D\n")], "file string, language string, src string"))
    assert "split_part" not in plan(events) and {(r.line, r.raw_context) for r in events.collect()} == {(2, "process.env.A_B; process.env.C_D")}
