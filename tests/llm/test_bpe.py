"""Encoding, decoding and counting against the tokenizers library itself."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from factweave.llm.bpe_codec import TOKENIZER as WORDS
from factweave.llm.bpe_codec import Codec, cuts_of, encode_decode, join_encodings
from factweave.llm.bpe_counts import TOKENIZER as BYTES
from factweave.llm.bpe_counts import Merges, Transducer, count_tokens, likely_start, tokenizer_path

ALPHABET = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "日", "本", "🙂", "...", "!", "<|endoftext|>", "the", " and", "ing", " ", "́", "'ve", "x'", "''", "\x1c", "\x85", "İ", "Σ", "가", "ᄀ", "ᅡ"]


def texts(n, longest, seed=1, alphabet=ALPHABET):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return Codec(tokenizer_path(WORDS))


@pytest.fixture(scope="module")
def transducer():
    return Transducer(Merges(tokenizer_path(BYTES)))


def test_short_texts_are_encoded_as_the_library_does(codec):
    for text, (n, ids, decoded) in zip(cases := texts(3000, 30), codec.encode_texts(cases)):
        e = codec.encode(text)
        assert (n, ids.decode()) == (len(e.ids), " ".join(map(str, e.ids)))
        assert decoded.decode() == codec.decode(e.ids)


@pytest.mark.parametrize("alphabet", [ALPHABET, ["a", "b", "th", "e", "ing"], ["s", "'", "!", "d"], ["é", "́", "가", "ᅡ", "ᄀ"]])
def test_joined_halves_are_the_encoding_of_the_whole(codec, alphabet):
    for i, text in enumerate(texts(400, 120, 3, alphabet)):
        cuts = cuts_of(len(text), 5 + i % 17)
        leaves = [codec.spans(text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        while len(leaves) > 1:
            leaves = [join_encodings(codec, text, cuts[k], cuts[k + 1], cuts[k + 2], leaves[k], leaves[k + 1], 1) for k in range(0, len(leaves), 2)]
            cuts = cuts[::2]
        assert leaves[0][:, 0].tolist() == codec.encode(text).ids


def test_counts_are_the_library_s(transducer):
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    for text in texts(3000, 40, 5):
        assert transducer.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("alphabet", [[a for a in ALPHABET if a != "<|endoftext|>"], ["a", "b", "th", "e", "ing", "'"], ["日", "本", "語"]])
def test_maps_of_pieces_compose(transducer, alphabet):
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    for i, text in enumerate(texts(300, 80, 7, alphabet)):
        size, n, reached = 1 + i % 9, 0, ()
        for k in range(0, len(text), size):
            likely = likely_start(transducer, text[max(0, k - 5 * size) : k])
            more, end = transducer.run(reached, text[k : k + size])
            if likely == reached:  # the map for the likely start is the one that is needed
                assert transducer.run(likely, text[k : k + size]) == (more, end)
            n, reached = n + more, end
        assert n == len(library.encode(text, add_special_tokens=False).ids)


def test_long_texts_without_white_space_are_counted_in_pieces(spark):
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    rnd = random.Random(11)
    long = ["".join(rnd.choice(a) for _ in range(4000)) for a in (["th", "e", "ing", "a"], ["日", "本", "é"], ["'s", "'", "l"], ["1"], ["!", "?"], [" "])]
    docs = spark.createDataFrame(list(enumerate([*long, long[0]])), "doc_id long, text string")
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate([*long, long[0]])}
    for piece, before in ((500, 64), (300, 0)):  # without characters before, likely starts are wrong, and mended
        assert {r.doc_id: r.n_tokens for r in count_tokens(docs, piece=piece, before=before).collect()} == want


def test_long_texts_take_rows_that_are_joined_level_by_level(spark):
    library = Tokenizer.from_file(tokenizer_path(WORDS))
    long = [*texts(3, 9000, 13), "abcdefgh" * 3000, "가" * 5000, "", "x"]
    docs = spark.createDataFrame(list(enumerate([*long, long[0]])), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids) for r in encode_decode(docs, leaf=50, row=400).collect()}
    for i, t in enumerate([*long, long[0]]):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), " ".join(map(str, ids)))


def test_tables_with_long_empty_null_and_repeated_texts(spark):
    long = "abcdefgh" * 500 + " <|endoftext|> " + "the cat, 12 dogs' tails  \n" * 300
    rows = [(1, long, "x"), (2, None, "y"), (3, "", "z"), (4, "a b", "x"), (4, "a b", "x"), (None, long, "w"), (5, "<|endoftext|>" * 400, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a name that the result has too
    words, counts = Tokenizer.from_file(tokenizer_path(WORDS)), Tokenizer.from_file(tokenizer_path(BYTES))
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids, r.decoded, r.ids_sha256) for r in encode_decode(docs, leaf=700).collect())
    want = []
    for i, text, _ in rows:
        ids = words.encode(text or "", add_special_tokens=False).ids
        joined = " ".join(map(str, ids))
        want.append((i or 0, len(ids), joined, words.decode(ids, skip_special_tokens=False), hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(docs, piece=700).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(counts.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert encode_decode(docs.limit(0)).count() == 0 and count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet", [ALPHABET, [a for a in ALPHABET if a.isascii() and "|" not in a], ["th", "e", " ", "é", "'s", "12", "\x85", "!"]])
def test_texts_of_many_leaves_are_encoded_as_the_library_does(codec, alphabet):
    cases = [t for longest in (400, 3000) for t in texts(40, longest, 17, alphabet)]
    for leaf in (90, 300):
        for text, (n, ids, decoded) in zip(cases, codec.encode_texts(cases, leaf)):
            e = codec.encode(text)
            assert (n, ids.decode(), decoded.decode()) == (len(e.ids), " ".join(map(str, e.ids)), codec.decode(e.ids))


def test_joins_of_a_batch_do_not_encode_one_by_one(codec, monkeypatch):
    """A window encoded at each join took a large share of the time."""
    calls = []
    monkeypatch.setattr(codec, "encode", lambda text: calls.append(text))
    cases = ["the cat, 12 dogs' tails " * 900, "été à la plage " * 1500]
    found = codec.encode_texts(cases)
    monkeypatch.undo()
    assert not calls and [f[1].decode() for f in found] == [" ".join(map(str, codec.encode(t).ids)) for t in cases]


def test_plain_joins_take_no_entry_apart(codec, monkeypatch):
    """Where a window holds whole pre-tokens of both sides, they are joined as they are."""
    import factweave.llm.bpe_codec as module

    words = ["the", "Running", "of", "it's", "naïve", "3.14", "(unbelievably)", "x_y"]
    many = texts(20, 9000, seed=5, alphabet=[w + " " for w in words])
    want = [codec.encode(t) for t in many]
    monkeypatch.setattr(module, "_spread", None)  # not callable
    for t, e, (n, ids, decoded) in zip(many, want, codec.encode_texts(many)):
        assert ids.decode() == " ".join(map(str, e.ids)) and n == len(e.ids) and decoded.decode() == codec.decode(e.ids)
