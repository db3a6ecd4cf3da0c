"""The registered queries themselves, on a small folder of tables, against plain code."""

import hashlib
import random
import re
from itertools import combinations
from zlib import crc32

import pytest
from tokenizers import Tokenizer

from factweave.llm.bpe_codec import TOKENIZER as WORDS
from factweave.llm.bpe_counts import TOKENIZER as BYTES
from factweave.llm.bpe_counts import tokenizer_path
from factweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))), ["en", "de"][i % 2], f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} {passage} Mail a{i}@b.org or +1 (555) 123-45{i:02}", "en", "s0") for i in range(10)]
    rows += [(200 + i, rows[i][1], "de", "s1") for i in range(8)] + [(300, None, None, None), (301, "", "en", None), (302, passage + " more", "en", "s2"), (303, passage, "en", "s2")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}


def test_encoding_and_counting(spark, folder):
    path, docs = folder
    words, counts = Tokenizer.from_file(tokenizer_path(WORDS)), Tokenizer.from_file(tokenizer_path(BYTES))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_bpe"](spark, path).collect()}
    for i, (_, text, *_) in docs.items():
        ids = words.encode(text or "", add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(words.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[i] == want
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op7_tokens"](spark, path).collect()}
    for i, (_, text, *_) in docs.items():
        n = len(counts.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 512)


def test_duplicates(spark, folder):
    path, docs = folder
    sets = {}
    for i, (_, text, *_) in docs.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[s : s + 4]) for s in range(len(w) - 3)} or ({tuple(w)} if w else set())
    up = {i: i for i in docs}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, b in combinations(docs, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_jaccard"](spark, path).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in docs} and got[303][1] == 302
    seen, want = set(), {}
    for i, (_, text, *_) in sorted(docs.items()):
        w, gone = WORD.findall(text or ""), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            gone.update(range(s, s + 20)) if k in seen else seen.add(k)
        want[i] = len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_repeats"](spark, path).collect()} == want


def test_rules_and_personal_data(spark, folder):
    path, docs = folder
    for r in QUERIES["op2_rules"](spark, path).collect():
        w = WORD.findall(docs[r.doc_id][1] or "")
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w))) and r.base_failed == (len(w) < 20) and not (r.base_failed and r.kept)
    for r in QUERIES["op3_personal_data"](spark, path).collect():
        text = docs[r.doc_id][1] or ""
        found = sorted((m.start(), k, m.end()) for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"\+[0-9][\x20().0-9-]+[0-9]")) for m in re.finditer(p, text))
        told = ",".join(f"{('email', 'phone')[k]}:{a}:{b}" for a, k, b in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (sum(k == 0 for _, k, _ in found), 0, 0, sum(k == 1 for _, k, _ in found))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_mix_and_language(spark, folder):
    path, docs = folder
    got = QUERIES["op5_mix"](spark, path).collect()
    size = {i: len(WORD.findall(t or "")) for i, (_, t, *_) in docs.items()}
    assert {r.doc_id: r["size"] for r in got} == size and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for s in {d[3] for d in docs.values()}:
        of = [r for r in got if docs[r.doc_id][3] == s]
        assert {r.source_size for r in of} == {sum(size[i] for i in docs if docs[i][3] == s)} and abs(sum(r.taken for r in of) - of[0].target) <= max(size.values())
    for r in QUERIES["op9_language"](spark, path).collect():
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id][1] or ""))
    for r in QUERIES["op4_quality"](spark, path).collect():
        assert r.kept in (True, False) and (r.perplexity is None) == (not (docs[r.doc_id][1] or "").strip())
