"""Substring, n-gram and vector duplicates against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import factweave.llm.jaccard_join as jaccard
from factweave.llm.components import connected_components
from factweave.llm.fm_index import FMIndex
from factweave.llm.id_filter import id_filter, may_be_in
from factweave.llm.jaccard_join import bands, keep_one_of_each, link_documents, shingle_set, signatures
from factweave.llm.range_join import link_vectors
from factweave.llm.substring_dedup import cut_repeats


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(140)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    want = smallest_reachable({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for a, b in edges if a != b for n in (a, b)} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 6, 500), 0)
    starts = np.arange(0, 480)
    low, high = FMIndex(text, 9).search(text, starts, 8)
    for s, n in zip(starts, high - low):
        assert n == sum((text[s : s + 8] == text[i : i + 8]).all() for i in range(len(text) - 8))


def brute_cut(docs):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone.update(range(s, s + 20)) if k in seen else seen.add(k)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_cut_repeats(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(15, 90))] for _ in range(8)]
    docs = {}
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
            words += ["x"] * rnd.choice([0, 0, 0, 45])
        docs[i] = rnd.choice([" ", "\n", "  "]).join(words)
    docs |= {900: None, 901: "", 902: "a b", 903: docs[3], 904: docs[3]}
    table = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, d int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in cut_repeats(table).collect()}
    assert got == brute_cut(docs)
    assert cut_repeats(table.limit(0)).count() == 0


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85, 95):
        levels = bands(percent, 3000)
        lows = [b.low for b in levels]
        for size in (7, 9, 20, 63, 250, 900):
            for _ in range(12):
                x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                most = (100 - percent) * len(x) // (100 + percent)  # each side differs in half of what may differ
                y = np.unique(np.concatenate([x[most:], rng.integers(0, 1 << 63, most, dtype=np.uint64)]))
                common = len(np.intersect1d(x, y))
                if 100 * common < percent * (len(x) + len(y) - common) or len(x) < lows[0] or len(y) < lows[0]:
                    continue
                both = []
                for z in (x, y):
                    b = int(np.searchsorted(lows, len(z), "right")) - 1
                    both.append({int(s) for n in (b, b + 1) if n < len(levels) for s in signatures(z, levels[n], n)[0]})
                assert (x == y).all() if len(x) == len(y) and common == len(x) else both[0] & both[1]


def test_signatures_of_a_set_and_its_extension_meet():
    rng = np.random.default_rng(7)
    for percent in (80, 85, 95):
        levels = bands(percent, 3000)
        lows = [b.low for b in levels]
        assert lows[0] == min(a for a in range(1, 100) if 100 * a >= percent * (a + 1))
        for size in range(1, 60):
            for more in range(1, 9):
                if 100 * size < percent * (size + more):
                    break
                y = np.unique(rng.integers(0, 1 << 63, size + more, dtype=np.uint64))
                both = []
                for z in (np.delete(y, rng.choice(size + more, more, replace=False)), y):
                    b = int(np.searchsorted(lows, len(z), "right")) - 1
                    assert b >= 0
                    both.append({int(s) for n in (b, b + 1) if n < len(levels) for s in signatures(z, levels[n], n)[0]})
                assert both[0] & both[1]


def test_short_texts_link_with_one_word_appended(spark):
    rnd = random.Random(8)
    docs = {}
    for i in range(60):
        w = [f"v{rnd.randrange(10_000)}" for _ in range(8 + i % 3)]
        docs |= {3 * i: " ".join(w), 3 * i + 1: " ".join([*w, "more"]), 3 * i + 2: " ".join([*w, "more", "still"])}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    for k, percent in ((4, 85), (5, 80)):
        sets = {i: {tuple(t.split()[s : s + k]) for s in range(len(t.split()) - k + 1)} for i, t in docs.items()}
        links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        assert any(min(len(sets[a]), len(sets[b])) == {4: 6, 5: 4}[k] for a, b in links)
        got = {r.doc_id: r.component_id for r in link_documents(table, k, percent).collect()}
        assert got == smallest_reachable(docs, links)


@pytest.mark.parametrize("group", [2, 6])
def test_link_documents(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", group)
    rnd = random.Random(6)
    words = [f"v{k}" for k in range(500)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([3, 8, 15, 40, 120, 300]))] for _ in range(25)]
    docs = {}
    for i in range(160):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, len(w) // 20])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        docs[i] = rnd.choice([" ", "\t\n"]).join(w).upper() if i % 3 else " ".join(w)
    docs |= {500: None, 501: "", 502: " \n", 503: "One", 504: "one", 505: "oné"}
    table = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, component_id int").repartition(4)
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(table, k, percent).collect()}
        sets = {}
        for i, t in docs.items():
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
            sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = smallest_reachable(docs, links)
        assert got == {i: (len(sets[i]), want[i]) for i in docs}
    kept = {r.doc_id for r in keep_one_of_each(table).collect()}
    assert kept == {i for i in docs if want[i] == i}
    assert link_documents(table.limit(0)).count() == 0


def test_shingles_of_short_and_missing_texts():
    assert len(shingle_set(None, 4)) == len(shingle_set(" ", 4)) == 0
    assert len(shingle_set("a b", 4)) == 1 and (shingle_set("A b", 4) == shingle_set("a  B", 4)).all()


def test_link_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(3))))
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [nan] * 16, 1), (903, [1.0, inf] + [0.0] * 14, 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0], 1), (907, [None] + [1.0] * 15, 1), (908, rows[1][1], rows[1][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(table).collect()}
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a, b in combinations(good, 2) if label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.93]
    want = smallest_reachable([r[0] for r in rows], links)
    assert got == {i: (sum(i in e for e in links), want[i], want[i] == i) for i in want}
    assert link_vectors(table.limit(0)).count() == 0


def test_signatures_take_as_many_bytes_in_many_buckets():
    """What a signature is shuffled with doesn't depend on how many buckets the table has."""
    rnd = random.Random(4)
    rows = pa.array([" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(200)) for _ in range(30)])
    levels = bands(80, 400)
    sizes = [sum(len(x.as_py()) for c in ("sigs", "sets", "levels") for x in jaccard.packed_signatures(rows, 5, 80, levels, n).column(c)) for n in (16, 5000)]
    assert sizes[0] == sizes[1] > 0


def shuffled_bytes(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch):
    """Only texts of ids that go, or that rows share, may be joined."""
    rnd = random.Random(9)
    docs = [(i, f"{rnd.getrandbits(16000):x}", "en") for i in range(600)] + [(7, "another", None), (8, "same", None), (8, "same", None), (None, "x", None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    linked = [(i, 1, 10 * (i // 10) if i % 10 in (3, 8) else i) for i, *_ in docs if i is not None] + [(None, 1, None)]
    monkeypatch.setattr(jaccard, "link_documents", lambda *_: spark.createDataFrame(linked, "doc_id long, n_shingles long, component_id long"))
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: spark.createDataFrame(df.collect(), df.schema))  # only what keep_one_of_each itself shuffles
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.createDataFrame(table.collect(), table.schema)
        before = shuffled_bytes(spark)
        got = keep_one_of_each(table).collect()
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    goes = {i for i, _, c in linked if i is not None and i != c}
    assert sorted(map(str, got)) == sorted(str(spark_row) for spark_row in table.dropDuplicates().collect() if spark_row.doc_id not in goes)
    assert moved < 0.5 * sum(len(t) for _, t, _ in docs)


def test_id_filter_lets_all_of_its_ids_through(spark):
    ids = spark.range(3000).selectExpr("concat('d', id * 7) as k")
    some = spark.range(20000).selectExpr("concat('d', id) as k").unionByName(spark.createDataFrame([(None,)], "k string"))
    got = [r.k for r in some.where(may_be_in("k", id_filter(ids, "k"))).collect()]
    want = {f"d{i}" for i in range(0, 20000, 7)}
    assert want <= set(got) and len(got) <= len(want) + 400
    assert some.where(may_be_in("k", id_filter(ids.limit(0), "k"))).count() == 0


def test_texts_without_candidates(spark):
    rnd = random.Random(10)
    table = spark.createDataFrame([(i, " ".join(str(rnd.random()) for _ in range(40))) for i in range(5)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in link_documents(table).collect()} == {i: i for i in range(5)}
    assert keep_one_of_each(table).count() == 5
