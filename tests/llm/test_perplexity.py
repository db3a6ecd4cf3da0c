"""Perplexities against plain Kneser-Ney over code points."""

import math
import random
from collections import Counter

import pytest

from factweave.llm import kneser_ney

V = 0x110000


def plain(trusted, texts):
    """Perplexity of texts by plain modified Kneser-Ney over the code points of 4-grams."""
    counts = {4: Counter(("\0\0\0" + t)[i : i + 4] for t in trusted for i in range(len(t)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    order = {}
    for k in range(1, 5):
        n = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        raw = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
        d = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(raw, 1)]
        total, held = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        order[k] = d, total, held

    def p(g):
        if not g:
            return 1 / V
        d, total, held = order[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        c = counts[len(g)][g]
        own = (c - d[min(c, 3) - 1]) / total[g[:-1]] if c else 0
        return own + held[g[:-1]] / total[g[:-1]] * p(g[1:])

    return [math.exp(-sum(math.log(p(("\0\0\0" + t)[i : i + 4])) for i in range(len(t))) / len(t)) if t else None for t in texts]


@pytest.mark.parametrize("chunk, block, few", [(1 << 24, 1 << 21, 65_535), (200, 60, 7)])
def test_perplexities_are_those_of_plain_kneser_ney(spark, monkeypatch, chunk, block, few):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("ALPHABET", few), ("FEW", few)):
        monkeypatch.setattr(kneser_ney, name, value)
    rnd = random.Random(8)
    words = ["the", "cat", "12", "7", "кот", "собака", "猫", "🙂", "é", "  ", "\n"]
    trusted = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    texts = [*trusted[:5], "", "the dog 99", "токсак", "\U0010ffff", "猫猫猫", "the  cat\n\n", "cat " * 300, None, trusted[0]]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in trusted], "text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_symbols, r.perplexity) for r in kneser_ney.perplexities(docs, model).collect()}
    for i, (t, want) in enumerate(zip(texts, plain(trusted, [t or "" for t in texts]))):
        assert got[i][0] == len(t or "") and got[i][1] == (want if want is None else pytest.approx(want, rel=1e-4))
    assert len(got) == len(texts)


def test_junk_in_other_scripts_and_digits_stands_out(spark):
    """Over classes of symbols, neither a code point beyond ASCII nor a digit could be told from others."""
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice(["кот", "дом", "лес", "год 1999", "река"]) for _ in range(60))
    # other letters with the same remainders by 4, and other digits
    bad = lambda: "".join(chr(ord(c) + 4 * rnd.randint(1, 6)) if ord(c) > 127 else rnd.choice("0345678") if c.isdigit() else c for c in good())
    rows = [(i, bad() if i % 5 == 0 else good(), "ru") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(150) if i % 5], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in kneser_ney.judge(docs, labels).collect()}
    assert not any(got[i] for i in range(0, 200, 5)) and sum(got[i] for i in range(200) if i % 5) > 150
