"""Traces under a budget, against a plain queue."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import graph

STEPS = "fn string, file string, dst_fn string, dst_file string, kind string"


def plain(starts, steps, budget, depth):
    after = {}
    for fn, file, dst_fn, dst_file, kind in set(steps):
        after.setdefault((fn, file), []).append((graph.STEP_KINDS.index(kind), dst_fn, dst_file, kind))
    spans, cuts = set(), {}
    for s in set(starts):
        level, left, cut = [((s,), False)], budget, 0
        spans.add((*s, 0, 1, "@".join(s), None, False))
        for d in range(1, depth + 1):
            offered = [(path, x) for path, again in level if not again for x in sorted(after.get(path[-1], []))]
            cut += max(len(offered) - left, 0)
            level = []
            for position, (path, (_, fn, file, kind)) in enumerate(offered[:left], 1):
                level.append(((*path, (fn, file)), (fn, file) in path))
                spans.add((*s, d, position, "/".join("@".join(x) for x in level[-1][0]), kind, level[-1][1]))
            left -= min(left, len(offered))
        cuts[s] = cut
    return spans, cuts


@pytest.mark.parametrize(("budget", "depth"), [(1, 3), (5, 4), (40, 2), (1000, 3)])
def test_traces_equal_a_queue(spark, budget, depth):
    rnd = random.Random(budget)
    nodes = [(f"f{i}", f"m{i % 3}") for i in range(25)]
    steps = [(*rnd.choice(nodes), *rnd.choice(nodes), rnd.choice(graph.STEP_KINDS)) for _ in range(60)] + [(*nodes[0], *n, "call") for n in nodes]  # a hub, itself included
    starts = [*nodes[:12], ("lonely", "m"), nodes[0]]
    spans, cuts = graph.traces(spark.createDataFrame(starts, "fn string, file string"), spark.createDataFrame(steps, STEPS).distinct(), budget, depth)
    got = {tuple(r) for r in spans.withColumn("path", F.array_join("path", "/")).collect()}
    want, left_out = plain(starts, steps, budget, depth)
    assert got == want
    assert {(r.start_fn, r.start_file): r.truncated for r in cuts.collect()} == left_out
    per_start = spans.where("depth > 0").groupBy("start_fn", "start_file").count().agg(F.max("count")).first()[0]
    assert per_start <= budget


def test_no_steps(spark):
    starts = spark.createDataFrame([("a", "b")], "fn string, file string")
    spans, cuts = graph.traces(starts, spark.createDataFrame([], STEPS))
    assert spans.count() == 1 and cuts.first()["truncated"] == 0
    spans, cuts = graph.traces(starts.limit(0), spark.createDataFrame([], STEPS))
    assert spans.count() == 0 and cuts.count() == 0


def test_steps_of_flows(spark):
    flows = spark.createDataFrame([("w", "a", "r", "a", "redis"), ("w", "a", "r", "b", "kafka")], "writer string, writer_file string, reader string, reader_file string, medium string")
    near = spark.createDataFrame([("w", "a", "x", "c")], "src_fn string, src_file string, dst_fn string, dst_file string")
    assert {tuple(r) for r in graph.trace_steps(near, flows).collect()} == {("w", "a", "x", "c", "call"), ("w", "a", "r", "a", "data_flow"), ("w", "a", "r", "b", "boundary_flow")}
