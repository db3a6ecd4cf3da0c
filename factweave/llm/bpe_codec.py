"""BPE encoding and decoding of texts of any length, by tree concatenation.

A text is cut in halves, those again, until each leaf is within ``LEAF`` characters,
wherever the cuts fall (inside a word, a combining sequence or a special token). Leaves
are encoded each on its own. Then the tree is joined upwards: around each join a window
of the text is encoded again and grown until it agrees with both sides, which means that
it holds a token of the left side and one of the right side unchanged (same id, same
characters). A BPE encoding is right exactly if all its neighbouring tokens may stand
side by side, so left tokens up to the one, window tokens between the two and right
tokens from the other on are the encoding of the whole.

The trees of ordinary texts are joined where they are read. A long text is cut into
rows, which are encoded in parallel and joined level by level, so many to a task as a
bound allows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_counts import tokenizer_path
from .pieces import keyed, pieces_of, sliced

TOKENIZER = "word_bpe_49k.json"
#: Characters of the longest leaf, and leaves of a row (longer texts take several rows).
LEAF, ROW_LEAVES = 2048, 30
#: Characters on either side of a join in the first window; it grows four times each time.
WINDOW = 64
#: Rows of a long text that one task joins.
FAN = 16
#: Entries of one worker's cache of pre-tokens, and characters of the longest one.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 32
#: The tokenizer's own pre-token pattern and, for texts of these characters only, no
#: normalisation but lower case (no character composes with another): fixed values.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def _pretoken(end: int) -> re.Pattern:
    """The pattern with classes of the characters below ``end``, which ``re`` searches faster."""
    of = lambda pattern: "".join(f"\\u{c:04x}" for c in range(end) if regex.match(pattern, chr(c)))
    return re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[%s]|[%s]+" % tuple(map(of, (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))))


PRETOKEN, ASCII_PRETOKEN = _pretoken(0x250), _pretoken(0x80)
WHITE = np.array([bool(regex.match(r"\s", chr(c))) for c in range(0x250)])
#: Characters of pre-tokens that are encoded together.
TOGETHER = 1 << 16


#: Tokens that stand together: decimal ids, token strings, and (start, end) of each from the first one's start on.
Entry = tuple[str, str, bytes | tuple[int, ...]]
#: An encoding: entries in order, and where each begins in the text.
Entries = tuple[list[Entry], np.ndarray | None]


class Codec:
    """A tokenizer file; one for each worker process."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work to cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.digits = [str(i) for i in range(len(self.names))]
        self.plain = self.tokenizer.decoder is None
        self.latin = self.tokenizer.pre_tokenizer is not None and path.endswith(TOKENIZER)
        self.cache: dict[str, Entry] = {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.window = max([WINDOW, *map(len, self.specials)])

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def encode_texts(self, texts: list[str], leaf: int = LEAF) -> list[tuple[int, bytes, bytes]]:
        """(number of tokens, decimal ids, decoded text) of each whole text."""
        out = []
        for entries, _ in self.joined(texts, leaf):
            ids = " ".join([e[0] for e in entries])
            decoded = " ".join([e[1] for e in entries]) if self.plain else self.decode(list(map(int, ids.split())))
            out.append((ids.count(" ") + 1 if ids else 0, ids.encode(), decoded.encode()))
        return out

    def told(self, spans: np.ndarray) -> tuple[int, bytes, bytes]:
        """(number of tokens, decimal ids, decoded text) of spans."""
        ids = spans[:, 0].tolist()
        # without a decoder, decoding joins the token strings by spaces
        decoded = " ".join([self.names[i] for i in ids]) if self.plain else self.decode(ids)
        return len(ids), " ".join(map(str, ids)).encode(), decoded.encode()

    def trees(self, texts: list[str], leaf: int = LEAF) -> list[np.ndarray]:
        """The spans of each whole text, joined from its leaves; the leaves of all texts are encoded together."""
        return [_spread(*entries) for entries in self.joined(texts, leaf, True)]

    def joined(self, texts: list[str], leaf: int, placed: bool = False) -> list[Entries]:
        """The entries of each whole text; without ``placed``, texts of one leaf have no starts."""
        cuts = [cuts_of(len(t), leaf) for t in texts]
        parts = [(t[a:b], a if placed or len(c) > 2 else None) for t, c in zip(texts, cuts) for a, b in zip(c, c[1:])]
        # the first windows of all joins are encoded with the leaves
        w = self.window
        windows = [(t[max(0, k - w) : k + w], max(0, k - w)) for t, c in zip(texts, cuts) for k in c[1:-1]]
        found = self.leaves([p for p, _ in parts + windows], [at for _, at in parts + windows])
        leaves, seams = iter(found[: len(parts)]), iter(found[len(parts) :])
        return [join_entries(self, text, c, [next(leaves) for _ in c[:-1]], {k: next(seams) for k in c[1:-1]}) for text, c in zip(texts, cuts)]

    def leaves(self, parts: list[str], places: list[int | None]) -> list[Entries]:
        """The entries of each leaf: of plain Latin ones their pre-tokens, which are encoded once, of the others their tokens."""
        lower = [p.lower() if self.latin and (p.isascii() or not BEYOND_LATIN.search(p)) and not any(s in p for s in self.specials) else None for p in parts]
        # a lower case of another length would move the characters
        units = [(ASCII_PRETOKEN if p.isascii() else PRETOKEN).findall(low) if low is not None and len(low) == len(p) else None for p, low in zip(parts, lower)]
        whole = iter(self.tokenizer.encode_batch([p for p, u in zip(parts, units) if u is None], add_special_tokens=False))
        long = self.learn(set().union(*[u for u in units if u]))
        out = []
        for low, of, at in zip(lower, units, places):
            if of is None:
                out.append(self.entries(_spans(next(whole), at or 0)))
                continue
            starts = None
            if at is not None:
                # pre-tokens cover all but white space, so their lengths lead from one to the next
                lengths = np.fromiter(map(len, of), np.int64, len(of))
                code_points = np.frombuffer(low.encode(), np.uint8) if low.isascii() else np.frombuffer(low.encode("utf-32-le"), np.uint32)
                covered = np.flatnonzero(~WHITE[code_points])
                starts = covered[np.cumsum(lengths) - lengths] + at
            out.append((list(map(self.cache.__getitem__, of)), starts))
        for u in long:
            del self.cache[u]
        return out

    def learn(self, units: set[str]) -> list[str]:
        """Encodes units that aren't in the cache, as entries; the long ones, which won't stay, are returned."""
        new = [u for u in units if u not in self.cache]  # a difference of sets would walk the whole cache
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
            new = list(units)
        ends = np.cumsum([len(u) + 1 for u in new])
        k = 0
        while k < len(new):
            j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + TOGETHER, "right")))
            self._learn(new[k:j])
            k = j
        return [u for u in new if len(u) > CACHE_CHARS]

    def _learn(self, units: list[str]) -> None:
        """Encodes units as one text with spaces between, which are the tokenizer's own borders of pre-tokens."""
        e = self.tokenizer.encode(" ".join(units), add_special_tokens=False)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes + 1) - sizes - 1
        offsets = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e.ids)).reshape(-1, 2)
        first = np.searchsorted(offsets[:, 0], starts)
        last = np.append(first[1:], len(offsets)) - 1
        whole = len(offsets) and (last >= first).all() and (offsets[first, 0] == starts).all() and (offsets[last, 1] == starts + sizes).all()
        if not whole:  # a unit lost its borders: each on its own
            for u, e in zip(units, self.tokenizer.encode_batch(units, add_special_tokens=False)):
                self.cache[u] = self.entry(e.ids, list(chain.from_iterable(e.offsets)))
            return
        ids, places = e.ids, (offsets - np.repeat(starts, last + 1 - first)[:, None]).reshape(-1).tolist()
        for u, a, b in zip(units, first.tolist(), (last + 1).tolist()):
            self.cache[u] = self.entry(ids[a:b], places[2 * a : 2 * b])

    def entry(self, ids: list[int], places: list[int]) -> Entry:
        small = not places or max(places) < 256
        return " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids]), bytes(places) if small else tuple(places)

    def entries(self, spans: np.ndarray) -> Entries:
        """The entries of spans: runs of tokens, each so short that a join need not take it apart for long."""
        cut = list(range(0, len(spans), 16))
        rows = spans.tolist()
        of = [rows[i : i + 16] for i in cut]
        return [self.entry([r[0] for r in g], [x - g[0][1] for r in g for x in r[1:]]) for g in of], spans[cut, 1]

    def spans(self, text: str, at: int = 0) -> np.ndarray:
        """Rows (id, start, end) of a text that begins at character ``at``."""
        return _spans(self.encode(text), at)


def _spans(e, at: int) -> np.ndarray:
    out = np.empty((len(e.ids), 3), dtype=np.int64)
    if len(e.ids):
        out[:, 0], out[:, 1:] = e.ids, np.asarray(e.offsets, dtype=np.int64) + at
    return out


def _spread(entries: list[Entry], starts: np.ndarray) -> np.ndarray:
    """The spans of entries."""
    out = np.empty((sum(len(e[2]) for e in entries) // 2, 3), np.int64)
    if len(out):
        out[:, 0] = np.array(" ".join([e[0] for e in entries]).split(), np.int64)
        out[:, 1:] = np.fromiter(chain.from_iterable(e[2] for e in entries), np.int64, 2 * len(out)).reshape(-1, 2)
        out[:, 1:] += np.repeat(starts, [len(e[2]) // 2 for e in entries])[:, None]
    return out


def _clean(spans: np.ndarray) -> np.ndarray:
    """Which tokens share no character with a neighbour (a character may be split over tokens)."""
    ok = spans[:, 2] > spans[:, 1]
    ok[1:] &= spans[1:, 1] >= spans[:-1, 2]
    ok[:-1] &= spans[:-1, 2] <= spans[1:, 1]
    return ok


def _shared(a: np.ndarray, b: np.ndarray, first: bool) -> tuple[int, int] | None:
    """Positions in a and b of the first or last token that both hold, unchanged."""
    there = {tuple(r): k for k, (r, ok) in enumerate(zip(b.tolist(), _clean(b).tolist())) if ok}
    order = range(len(a)) if first else range(len(a) - 1, -1, -1)
    clean, rows = _clean(a), a.tolist()
    for k in order:
        if clean[k] and (j := there.get(tuple(rows[k]))) is not None:
            return k, j
    return None


def join_encodings(codec: Codec, text: str, lo: int, cut: int, hi: int, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The encoding of text[lo:hi] from those of text[lo:cut] and text[cut:hi].

    A special token across the join must lie in the first window, which is long enough for any.
    """
    w = max([window, *map(len, codec.specials)])
    while True:
        if (joined := _joined(codec, text, lo, cut, hi, left, right, w)) is not None:
            return joined
        w *= 4


def _joined(codec: Codec, text: str, lo: int, cut: int, hi: int, left: np.ndarray, right: np.ndarray, w: int, mid: np.ndarray | None = None) -> np.ndarray | None:
    """The same by a window of ``w`` characters on either side, if that agrees with both sides.

    Of ``left`` only tokens from ``cut - w`` on matter, of ``right`` those up to ``cut + w``.
    """
    a, b = max(lo, cut - w), min(hi, cut + w)
    mid = codec.spans(text[a:b], a) if mid is None else mid
    from_left = (0, 0) if a == lo else _shared(mid, left[np.searchsorted(left[:, 1], a) :], True)
    from_right = (len(mid), len(right)) if b == hi else _shared(mid, right[: np.searchsorted(right[:, 1], b)], False)
    if from_left is None or from_right is None or from_left[0] > from_right[0]:
        return None
    i = 0 if a == lo else from_left[1] + np.searchsorted(left[:, 1], a)
    return np.concatenate([left[:i], mid[from_left[0] : from_right[0]], right[from_right[1] :]])


def cuts_of(length: int, leaf: int) -> list[int]:
    """Boundaries of the leaves: halves of halves, all within ``leaf``."""
    n = 1
    while -(-length // n) > leaf:
        n *= 2
    return [length * k // n for k in range(n + 1)]


def join_tree(codec: Codec, text: str, cuts: list[int], leaves: list[np.ndarray]) -> np.ndarray:
    """Joins neighbouring encodings, level by level; an odd last one waits for the next level."""
    while len(leaves) > 1:
        odd = leaves[-1:] if len(leaves) % 2 else []
        leaves = [join_encodings(codec, text, cuts[k], cuts[k + 1], cuts[k + 2], leaves[k], leaves[k + 1]) for k in range(0, len(leaves) - 1, 2)] + odd
        cuts = cuts[::2] if not odd else [*cuts[::2], cuts[-1]]
    return leaves[0]


def join_entries(codec: Codec, text: str, cuts: list[int], leaves: list[Entries], windows: dict[int, Entries]) -> Entries:
    """``join_tree`` on entries; ``windows`` are those of each cut's first window."""
    while len(leaves) > 1:
        odd = leaves[-1:] if len(leaves) % 2 else []
        leaves = [_join_entries(codec, text, cuts[k], cuts[k + 1], cuts[k + 2], leaves[k], leaves[k + 1], windows[cuts[k + 1]]) for k in range(0, len(leaves) - 1, 2)] + odd
        cuts = cuts[::2] if not odd else [*cuts[::2], cuts[-1]]
    return leaves[0]


def _join_entries(codec: Codec, text: str, lo: int, cut: int, hi: int, left: Entries, right: Entries, window: Entries) -> Entries:
    w = codec.window
    if lo < cut - w and cut + w < hi and (joined := _joined_whole(cut, w, left, right, window)) is not None:
        return joined
    while True:
        a, b = max(0, cut - w), min(len(text), cut + w)
        # the entries with tokens that begin in the window, and at its left end the one before
        i = max(0, int(np.searchsorted(left[1], cut - w)) - 1) if cut - w > lo else 0
        j = int(np.searchsorted(right[1], cut + w)) if cut + w < hi else len(right[0])
        seam = _joined(codec, text, lo, cut, hi, _spread(left[0][i:], left[1][i:]), _spread(right[0][:j], right[1][:j]), w, _spread(*window) if w == codec.window and a >= lo and b <= hi else None)
        if seam is not None:
            entries, starts = codec.entries(seam)
            return left[0][:i] + entries + right[0][j:], np.concatenate([left[1][:i], starts, right[1][j:]])
        w *= 4


def _joined_whole(cut: int, w: int, left: Entries, right: Entries, window: Entries) -> Entries | None:
    """The join if the window holds whole entries of both sides unchanged: no token need be looked at."""
    (mid, starts), of = window, window[1].tolist()
    i, j = int(np.searchsorted(left[1], cut - w)), int(np.searchsorted(right[1], cut + w))
    before = {at: k for k, at in enumerate(left[1][i:].tolist(), i)}
    after = {at: k for k, at in enumerate(right[1][:j].tolist())}
    same = lambda side, there, m: mid[m][2] and (k := there.get(of[m])) is not None and side[0][k] == mid[m]
    first = next((m for m in range(len(mid)) if same(left, before, m)), None)
    last = next((m for m in range(len(mid) - 1, -1, -1) if same(right, after, m)), None)
    if first is None or last is None or first > last:
        return None
    i, j = before[of[first]], after[of[last]]
    return left[0][:i] + mid[first:last] + right[0][j:], np.concatenate([left[1][:i], starts[first:last], right[1][j:]])


_made: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


_OUT = "n_tokens long, ids string, decoded string, ids_sha256 string, decoded_sha256 string"


def _columns(found: list[tuple[int, bytes, bytes]], contents: tuple[str, ...]) -> list[pa.Array]:
    digest = lambda k: pa.array([hashlib.sha256(f[k]).hexdigest() for f in found], pa.string())
    text = lambda k: pa.array([f[k].decode() for f in found] if ("", "ids", "decoded")[k] in contents else [None] * len(found), pa.string())
    return [pa.array([f[0] for f in found], pa.int64()), text(1), text(2), digest(1), digest(2)]


def encode_decode(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF, contents: tuple[str, ...] = ("ids", "decoded"), row: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces), decoded, and both digests for each input row.

    ids and decoded are null if ``contents`` leaves them out. A null text counts as empty: no
    tokens, empty strings. A text beyond ``row`` characters (60 leaves) is dealt over several
    rows; its result is one row. Repeated rows give a row each; an empty table gives no
    rows; other columns are ignored.
    """
    path, row = tokenizer or tokenizer_path(TOKENIZER), row or ROW_LEAVES * leaf
    rows = keyed(docs, doc_id, text, row)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in sliced(batches, 64):
            found = codec.encode_texts(b.column("text").to_pylist(), leaf)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(found, contents)], ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    few = rows.where("__key is null").select("doc_id", "text").mapInArrow(short, f"doc_id {id_type}, {_OUT}")
    many = rows.where("__key is not null").select("doc_id", "__key").join(_long(rows, path, leaf, row, contents), "__key")
    return few.unionByName(many.drop("__key"))


def _long(rows: DataFrame, path: str, leaf: int, row: int, contents: tuple[str, ...]) -> DataFrame:
    """__key and the results of each distinct long text: rows encoded in parallel, then joined level by level."""
    encoded_rows = "__key string, no int, part string, spans binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in sliced(batches, 8):  # spans take more room than text: few rows at once
            spans = [x.astype(np.uint32).tobytes() for x in codec.trees(b.column("part").to_pylist(), leaf)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__key", "no", "part")), pa.array(spans, pa.binary())], ["__key", "no", "part", "spans"])

    def joined(pdf):
        codec = codec_of(path)
        pdf = pdf.sort_values("no")
        text, cuts = "".join(pdf["part"]), [0, *np.cumsum([len(p) for p in pdf["part"]]).tolist()]
        parts = [np.frombuffer(x, dtype=np.uint32).reshape(-1, 3).astype(np.int64) + (0, at, at) for x, at in zip(pdf["spans"], cuts)]
        spans = join_tree(codec, text, cuts, parts).astype(np.uint32).tobytes()
        return pdf.iloc[:1][["__key"]].assign(no=int(pdf["no"].iloc[0]) // FAN, part=text, spans=spans)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in sliced(batches, 1):
            found = [codec.told(np.frombuffer(x.as_py(), dtype=np.uint32).reshape(-1, 3)) for x in b.column("spans")]
            yield pa.RecordBatch.from_arrays([b.column("__key"), *_columns(found, contents)], ["__key", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    most = rows.where("__key is not null").agg(F.max(F.length("text")).alias("n")).first()["n"] or 0
    level = pieces_of(rows, row).mapInArrow(encoded, encoded_rows)
    left = -(-most // row)
    while left > 1:
        level = level.groupBy("__key", F.floor(F.col("no") / FAN)).applyInPandas(joined, encoded_rows)
        left = -(-left // FAN)
    return level.select("__key", "spans").mapInArrow(told, f"__key string, {_OUT}")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: digests of the encoding and of the decoded text of every document."""
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), contents=())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
