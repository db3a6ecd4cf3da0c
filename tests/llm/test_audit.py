"""The filter audit against plain Python."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.llm.filter_audit import audit_filters, duplicate_marks

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, mask string, `__id` int"


def plain(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    texts = [t or "" for _, t, *_ in docs]
    ids = [d[0] for d in docs]

    def failed(i):
        text, words = texts[i], WORD.findall(texts[i])
        copy = ids[i] is not None and any(ids[j] is not None and ids[j] < ids[i] and texts[j] == text for j in range(len(docs)))
        bad = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), copy)
        return {x for x, b in zip("ABCDE", bad) if b}

    fails = [failed(i) for i in range(len(docs))]
    out, total = {}, Counter()
    for part in {d[2] or "" for d in docs}:
        mine = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                gone = [i for i in mine if x in fails[i] and not fails[i] & set(order[: step - 1])]
                out[part, order, step] = [
                    sum(not fails[i] & set(order[:step]) for i in mine), len(gone), sum(x in fails[i] for i in mine) - len(gone), sum(fails[i] == {x} for i in mine),
                    sum(ids[i] in good for i in gone), sum(ids[i] in toxic for i in gone),
                ]
                total[part, x] += len(gone)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def documents():
    wide = " ".join(f"word{i}" for i in range(120))
    long = " ".join(f"w{i}é" for i in range(40_000))
    texts = [None, "", "", "a b", wide, wide, wide + " #", wide.upper(), "same " * 150, wide, long, long, long + "x", "y" + long[1:], "\x0b\x0c", "A|", None, wide + " \U0001f600"]
    rows = [(i if i != 3 else None, t, ["en", None, "", "de"][i % 4], "m", i) for i, t in enumerate(texts)]
    return [*rows, (4, wide, "en", None, None), (None, wide, "fr", None, None)]


def test_audit_equals_plain_python(spark):
    docs = documents()
    labels = [(0, 1, 0), (0, 0, 1), (5, 1, 1), (9, None, 1), (11, 1, None), (None, 1, 1), (99, 1, 1), (8, 0, 0)]
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = audit_filters(spark.createDataFrame(docs, DOCS), made)
    assert {tuple(r) for r in got.collect()} == plain(docs, labels)


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda block: F.lit(7).cast("bigint"), lambda block: F.length(block).cast("bigint")])
def test_texts_decide_where_hashes_meet(spark, hash_of):
    rng = [i * 7919 % 23 for i in range(200)]
    rows = [(i if i % 17 else None, "".join("ab"[(x >> b) & 1] for b in range(x % 5))) for i, x in enumerate(rng)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r["id"], r["is_copy"]) for r in duplicate_marks(lambda: df, [], 2, hash_of).collect() if r["id"] is not None)
    least = {}
    for i, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    assert got == sorted((i, i > least[t]) for i, t in rows if i is not None)
    assert duplicate_marks(lambda: df, [], 2, hash_of).where("id is null").count() == sum(i is None for i, _ in rows)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    assert audit_filters(one, labels).where("removed = 1").count() == 120  # A, wherever it stands
