"""Phrase mining against plain Python: broadcast and joined levels, cut rows, long texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.llm.collocations import collocations, slices, weakest_cut

DOCS = "doc_id long, text string, lang string, n long, id string"


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.split("\n")]


def plain(docs, support, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            for k in range(1, 6):
                f.update((lang or "und", tuple(p[i : i + k])) for i in range(len(p) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= support:
            holds = any(q[:1] == (lang,) and len(q[1]) > len(p) and b >= support and b >= a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, b in f.items())
            if not holds:
                score, cut = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j) for j in range(1, len(p)))
                found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), cut, f[lang, p[:cut]], f[lang, p[cut:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s, cut) for lang, rows in found.items() for i, (s, a, p, cut, left, right) in enumerate(sorted(rows)[:top], 1)}


def documents():
    rnd = random.Random(5)
    some = ["New york city is big", "a a a a a", "new York CITY", "l'été à la plage; zürich", "x\ty\x0bz new\x0ayork", "one, two. one two"]
    rows = [(i, " ".join(rnd.choice(some) + rnd.choice(["", ".", " ", "\r"]) for _ in range(rnd.randint(0, 9))), rnd.choice(["en", None, "fr"]), 1, "x") for i in range(60)]
    return [*rows, (90, None, "en", None, None), (91, "", None, 1, ""), (91, "", None, 1, ""), (92, "a b c d e f " * 3000, "en", 0, ""), (93, "\xa0\x00 é " * 50, "de", 0, "")]


@pytest.mark.parametrize("options", [{}, {"chunk": 5}, {"most": 0}, {"most": 0, "chunk": 7}, {"chars": 0, "chunk": 16}])
def test_phrases_equal_plain_python(spark, options):
    docs = documents()
    if options:
        docs = docs[:63]  # plain code is slow for the long text
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    for support, top in ((4, 2000), (9, 3)):
        assert {tuple(r) for r in collocations(df, support=support, top=top, **options).collect()} == plain(docs, support, top)


def test_slices_cut_between_words():
    text = "Ab, cd\tef. " * 7 + "\xe9g" * 40 + "\nlast"
    whole = [w for part in slices(text) for w in part]
    for size in (1, 2, 5, 64):
        assert [w for part in slices(text, size) for w in part] == whole
    assert whole[:5] == [b"ab", b"\xff", b"cd", b"ef", b"\xff"]
    assert not list(slices(None)) and not list(slices(""))


def test_products_beyond_64_bits(spark):
    a, left, right, n = 3 * 10**12, 5 * 10**12, 7 * 10**12, 10**15 - 1
    row = spark.range(1).select(F.array(F.lit(left), F.lit(a)).alias("pre"), F.array(F.lit(right), F.lit(a)).alias("suf"), F.lit(a).alias("a"), F.lit(n).alias("n"))
    got = row.select(weakest_cut(F.col("pre"), F.col("suf"), F.col("a"), F.col("n")).alias("c")).first()["c"]
    assert tuple(got) == (1000 * a * n // (left * right), 1, left, right)


def test_nothing_frequent(spark):
    assert collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b", "en", 1, "")], DOCS)).count() == 0
