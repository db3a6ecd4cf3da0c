"""Secrets: by pattern, and by a linear-chain conditional random field over tokens.

Patterns find values that are assigned to a secret's name, access keys and long hexadecimal
strings. What they find in a bounded sample of texts labels the tokens there as begin, inside or
outside of a secret, and a conditional random field learns from these: each token's own shape
and word, its neighbouring tokens and words, and features of the whole text give a score for each
tag, neighbouring tags another one. So that it learns what secrets look like, not the three
patterns, each labelled place also occurs with another name and a random value of another
shape. Every text is then tagged by its best path (Viterbi); what that path calls a secret and
no pattern has found is added.

Tokenizing, scoring and decoding are array operations over the tokens of many texts at once.
The best path is exact: paths are extended in all stretches of the sequence at once, from
each tag that a stretch may be entered with, and stretches are joined by their best entries.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

KINDS = ("assign", "access", "hex", "secret")
#: Shortest match that counts; of assign it is the value's length.
LEAST = {"assign": 6, "access": 20, "hex": 24, "secret": 6}
#: Patterns by kind, fixed values; hex asks for whole runs of its length at once.
PATTERNS = {
    "assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"),
}
#: The training sample: windows with a secret, and without, at most; how many of the latter for one of the former, texts for them, places of a text.
TRAIN_WINDOWS, CLEAN_WINDOWS, CLEAN_RATIO, CLEAN_TEXTS, PLACES = 1500, 4500, 4, 600, 4
#: Steps of training, and windows in each.
STEPS, BATCH = 300, 200
#: Windows that a feature must occur in to get a weight, and what damps the steps of rare ones.
CUTOFF, DAMPING = 4, 1.0
#: Tokens of a window, characters around a place that it is cut from, and places made from a labelled one.
WINDOW, MARGIN, VARIANTS = 48, 240, 4
#: Weights: hashed to so many rows.
ROWS = 1 << 18
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
NEVER = -1e4
#: Characters read and tokens scored at once.
SLICE, BLOCK = 1 << 20, 1 << 15
#: Characters of short texts that are read together, and of a batch that is tagged at once.
TOGETHER, AT_ONCE = 1 << 17, 1 << 20


_HEX_BYTES = bytes(ord("a") if c in b"0123456789abcdef" else ord(" ") for c in range(256))


def _may_match(kind: str, text: str) -> bool:
    """Plain searches, much faster than the patterns, for what every match holds."""
    if kind == "assign":
        low = text.encode("utf-8", "replace").lower()
        return any(w in low for w in (b"passw", b"secret", b"token", b"api_key", b"apikey"))
    if kind == "access":
        return "AKIA" in text
    return b"a" * LEAST["hex"] in text.encode("utf-8", "replace").translate(_HEX_BYTES)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of all pattern matches, by start, then kind."""
    found = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text) if _may_match(name, text) else ():
            at = m.start(2) if name == "assign" else m.start()
            if m.end() - at >= LEAST[name]:
                found.append((m.start(), kind, m.end(), at))
    return sorted(found)


# --- tokens ------------------------------------------------------------------------------

_SPACE, _MARK, _DIGIT, _UPPER, _LOWER, _SIGN = range(6)
_CLASS = np.full(128, _MARK, np.uint8)
_CLASS[: 0x21] = _SPACE
_CLASS[0x7F] = _SPACE
for _chars, _class in (("0123456789", _DIGIT), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("abcdefghijklmnopqrstuvwxyz", _LOWER), ("+/_.-~@%", _SIGN)):
    _CLASS[[ord(c) for c in _chars]] = _class
_HEX = np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_POSITION = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
_LENGTHS, _CHANGES = np.array([2, 3, 5, 8, 12, 16, 20, 28, 40]), np.array([1, 2, 3, 5, 9])


@dataclass
class Tokens:
    """start, end, word (hash in lower case), shape, change (class changes and length), is_hex (and length), mark of each token."""

    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    shape: np.ndarray
    change: np.ndarray
    hexes: np.ndarray
    mark: np.ndarray

    @staticmethod
    def joined(parts: list[Tokens]) -> Tokens:
        return Tokens(*(np.concatenate([getattr(p, f) for p in parts]) for f in Tokens.__dataclass_fields__))


def _share(part: np.ndarray, whole: np.ndarray, bounds) -> np.ndarray:
    """0 for none, then by share, and all of it as the last."""
    return np.where(part == 0, 0, np.where(part == whole, len(bounds) + 1, np.searchsorted(bounds, part / whole) + 1))


def _tokens(text: str, offset: int) -> Tokens:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = np.minimum(code, 127).astype(np.uint8)
    kind = np.where(code < 128, _CLASS[ascii_], np.where((code == 0xA0) | (code == 0x85), _SPACE, _LOWER)).astype(np.uint8)
    body = kind > _MARK
    before = np.concatenate(([False], body[:-1]))
    is_start = (kind == _MARK) | (body & ~before)
    start = np.flatnonzero(is_start)
    if not len(start):
        none = np.empty(0, np.int64)
        return Tokens(none, none, none.astype(np.uint64), none, none, none, none.astype(bool))
    mark = kind[start] == _MARK
    end = start + 1
    end[~mark] = np.flatnonzero(body & ~np.concatenate((body[1:], [False]))) + 1
    total = lambda x: np.add.reduceat(x.astype(np.int32), start)  # noqa: E731  # only spaces lie between tokens
    size = end - start
    at = np.arange(len(code)) - start[np.maximum(np.cumsum(is_start) - 1, 0)]
    low = (code + np.where(kind == _UPPER, 32, 0)).astype(np.uint64)
    word = np.add.reduceat(np.where(kind == _SPACE, np.uint64(0), low * _POSITION[np.clip(at, 0, 63)]), start)
    digits, uppers, signs = total(kind == _DIGIT), total(kind == _UPPER), total(kind == _SIGN)
    long = np.searchsorted(_LENGTHS, size, "right")
    changes = total(body & before & (kind != np.concatenate(([0], kind[:-1]))))
    shape = ((long * 4 + _share(digits, size, [0.2, 0.5])) * 4 + _share(uppers, size, [0.5])) * 3 + np.minimum(signs, 2)
    hexes = np.where(total(_HEX[ascii_] & (code < 128)) == size, long + 1, 0)
    return Tokens(start + offset, end + offset, word, shape, np.searchsorted(_CHANGES, changes, "right") * 10 + long, hexes, mark)


def tokens_of(text: str, size: int = SLICE) -> Tokens:
    """All tokens of a text: marks one by one, and runs of what is neither mark nor white space; a slice at a time."""
    parts, at = [], 0
    while True:
        cut = at + size
        if cut < len(text):
            space = text.find(" ", cut)
            cut = len(text) if space < 0 else space + 1
        parts.append(_tokens(text[at:cut], at))
        at = cut
        if at >= len(text):
            return Tokens.joined(parts)


def file_feature(text: str) -> int:
    """Of a whole text: how common digits and signs of assignment and nesting are in it."""
    n = max(len(text), 1)
    digits, signs = sum(map(text.count, "0123456789")), sum(map(text.count, "={}()\"':"))
    bounds = [0.001, 0.01, 0.05]
    return int(np.searchsorted(bounds, digits / n)) * 4 + int(np.searchsorted(bounds, signs / n))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_ASSIGNS = (np.array([ord(c) for c in "=:"], np.uint64) * _POSITION[0]).tolist()
N_FEATURES = 16
_SALTS = np.arange(1, N_FEATURES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
#: Tokens within which a neighbouring word counts.
FAR = 64


def features(t: Tokens, first: np.ndarray, last: np.ndarray, file: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Rows of weights for tokens lo to hi: (hi - lo, N_FEATURES). first, last: bounds of each token's text; file: its file feature."""
    at = np.arange(lo, hi)
    first, last, file = first[lo:hi], last[lo:hi], file[lo:hi].astype(np.uint64)
    reach = slice(max(lo - 256, 0), min(hi + 256, len(t.start)))
    words = np.where(t.mark[reach], -1, np.arange(reach.start, reach.stop))
    back = np.maximum.accumulate(words)
    ahead = np.where(words < 0, 1 << 60, words)[::-1]
    ahead = np.minimum.accumulate(ahead)[::-1]
    n = reach.stop

    def token(values, i, ok):
        return np.where(ok, values[np.clip(i, 0, len(values) - 1)], 0).astype(np.uint64)

    def before(i):  # the word before a token, -1 if there is none in its text
        j = np.where(i - 1 >= reach.start, back[np.clip(i - 1 - reach.start, 0, len(back) - 1)], -1)
        return np.where((j >= first) & (i - j <= FAR), j, -1)

    w1 = before(at)
    w2 = np.where(w1 >= 0, before(w1), -1)
    j = np.where(at + 1 < n, ahead[np.clip(at + 1 - reach.start, 0, len(ahead) - 1)], 1 << 60)
    w3 = np.where((j < last) & (j - at <= FAR), j, -1)
    prev, next_, prev2 = at - 1 >= first, at + 1 < last, at - 2 >= first
    assigned = np.zeros(hi - lo, bool)
    for back_by in (1, 2, 3):
        i = at - back_by
        assigned |= (i > w1) & (i >= first) & np.isin(t.word[np.clip(i, 0, None)], np.array(_ASSIGNS, np.uint64))
    shape, has_digit = t.shape.astype(np.uint64), (t.shape // 12) % 4 > 0
    one = np.uint64(1)
    said = np.where(has_digit, one, t.word)  # what holds digits has no word of its own
    values = [
        np.zeros(hi - lo, np.uint64), shape[lo:hi], t.change[lo:hi].astype(np.uint64), said[lo:hi], t.hexes[lo:hi].astype(np.uint64),
        token(said, at - 1, prev), token(said, at + 1, next_), token(said, at - 2, prev2),
        token(said, w1, w1 >= 0), token(said, w1, w1 >= 0) + one + assigned.astype(np.uint64), token(said, w2, w2 >= 0), token(said, w3, w3 >= 0),
        file, file * np.uint64(4096) + t.change[lo:hi].astype(np.uint64), token(shape + one, at - 1, prev), token(shape + one, at + 1, next_),
    ]
    salted = [(v + s) * _MIX for v, s in zip(values, _SALTS)]
    return np.stack([(v ^ (v >> np.uint64(31))) * _MIX >> np.uint64(46) for v in salted], 1).astype(np.int32)  # 18 bits


# --- the field ---------------------------------------------------------------------------


@dataclass
class Field:
    """weights (ROWS, 3), steps[x, y]: from tag x to tag y, begin[y]: as the first tag."""

    weights: np.ndarray
    steps: np.ndarray
    begin: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = self.weights[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            out = out + self.weights[rows[:, k]]
        return out


def best_path(scores: np.ndarray, starts: np.ndarray, steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The tags of the best path through each sequence; ``starts`` says where sequences begin.

    Exact: the sequence is cut into about sqrt(n) stretches. The best path through each one
    is extended token by token for every tag that it may be entered with, then entries
    are chosen from the first stretch to the last one, and tags read backwards.
    """
    n = len(scores)
    if not n:
        return np.empty(0, np.int8)
    long = max(1, int(np.sqrt(n)))
    many = -(-n // long)
    s = np.zeros((many * long, 3))
    s[:n] = scores
    fresh = np.ones(many * long, bool)  # what pads the end begins anew
    fresh[:n] = starts
    s, fresh = s.reshape(many, long, 3), fresh.reshape(many, long)
    state = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)[None].repeat(many, 0)  # entered with x, now at y
    came = np.empty((long, many, 3, 3), np.int8)
    for k in range(long):
        move = np.where(fresh[:, k, None, None], begin[None, None, :], steps[None])  # from z to y
        reached = state[:, :, :, None] + move[:, None]
        came[k] = reached.argmax(2)
        state = reached.max(2) + s[:, k, None, :]
    total, entries = np.zeros(3), np.empty((many, 3), np.int8)
    for k in range(many):
        through = total[:, None] + state[k]
        entries[k] = through.argmax(0)
        total = through.max(0)
    leave = np.empty(many, np.int64)
    y = int(total.argmax())
    enter = np.empty(many, np.int64)
    for k in range(many - 1, -1, -1):
        leave[k], enter[k] = y, entries[k, y]
        y = int(enter[k])
    tags, each = np.empty((many, long), np.int8), np.arange(many)
    y = leave
    for k in range(long - 1, -1, -1):
        tags[:, k] = y
        y = came[k, each, enter, y].astype(np.int64)
    return tags.reshape(-1)[:n]


def log_likelihood(scores: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: np.ndarray, begin: np.ndarray):
    """Of sequences (n, T) padded where the mask is 0: sum of log p(tags), and its derivatives by scores, steps and begin."""
    n, T, _ = scores.shape
    alpha, lse = np.empty((T, n, 3)), lambda x, axis: np.log(np.exp(x - (m := x.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    alpha[0] = begin + scores[:, 0]
    for t in range(1, T):
        new = lse(alpha[t - 1][:, :, None] + steps[None], 1) + scores[:, t]
        alpha[t] = np.where(mask[:, t, None], new, alpha[t - 1])
    z = lse(alpha[-1], 1)
    beta, expected, d_steps = np.zeros((n, 3)), np.zeros_like(scores), np.zeros((3, 3))
    for t in range(T - 1, -1, -1):
        expected[:, t] = np.exp(alpha[t] + beta - z[:, None]) * mask[:, t, None]
        if t:
            ahead = beta + scores[:, t]
            both = np.exp(alpha[t - 1][:, :, None] + steps[None] + ahead[:, None, :] - z[:, None, None]) * mask[:, t, None, None]
            d_steps -= both.sum(0)
            beta = np.where(mask[:, t, None], lse(steps[None] + ahead[:, None, :], 2), beta)
    d_begin = -expected[:, 0].sum(0)
    seen = np.eye(3)[tags] * mask[:, :, None]
    d_begin += seen[:, 0].sum(0)
    np.add.at(d_steps, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
    of_tags = (scores * seen).sum() + (steps[tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum() + begin[tags[:, 0]].sum()
    return of_tags - z.sum(), seen - expected, d_steps, d_begin


def train(rows: np.ndarray, tags: np.ndarray, mask: np.ndarray, rate: float = 0.3, decay: float = 1e-3, seed: int = 1) -> Field:
    """A field for windows (n, T, N_FEATURES), by Adagrad on the likelihood with an L2 penalty."""
    rng = np.random.default_rng(seed)
    known, dense = np.unique(rows[mask], return_inverse=True)
    of = np.repeat(np.arange(len(rows)), mask.sum(1) * rows.shape[2])
    pairs = np.unique(of * np.int64(len(known)) + dense.reshape(-1))
    often = np.bincount(pairs % len(known), minlength=len(known)) >= CUTOFF
    number = np.where(often, np.cumsum(often), 0)  # 0 stands for all that are too rare
    small = np.zeros(rows.shape, np.int32)
    small[mask] = number[dense.reshape(-1, rows.shape[2])]
    n = int(often.sum()) + 1
    weights, steps, begin = np.zeros((n, 3)), np.zeros((3, 3)), np.zeros(3)
    steps[OUTSIDE, INSIDE] = begin[INSIDE] = NEVER  # inside follows begin or inside
    seen = [np.full_like(x, DAMPING) for x in (weights, steps, begin)]
    for _ in range(STEPS):
        part = rng.integers(0, len(rows), min(BATCH, len(rows)))
        r, m = small[part], mask[part]
        _, d, d_steps, d_begin = log_likelihood(weights[r].sum(2), tags[part], m, steps, begin)
        flat = r[m].reshape(-1)
        pull = np.stack([np.bincount(flat, np.repeat(d[m][:, y], r.shape[2]), n) for y in range(3)], 1)
        pull[0] = 0
        for value, slope, past in ((weights, pull - decay * weights, seen[0]), (steps, d_steps, seen[1]), (begin, d_begin, seen[2])):
            free = value > NEVER / 2
            past += slope**2
            value += np.where(free, rate * slope / np.sqrt(past), 0)
    full = np.zeros((ROWS, 3), np.float32)
    full[known[often]] = weights[1:]
    return Field(full, steps, begin)


# --- the sample --------------------------------------------------------------------------

#: Names and values of the labelled places that are made from found ones.
NAMES = ("pwd", "passphrase", "credential", "client_secret", "access_token", "auth", "private_key", "api-key", "bearer", "authorization", "license_key", "signing_key")
ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
)


def window(snippet: str, start: int, end: int, others: list[tuple[int, int]], file: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature rows and tags of at most WINDOW tokens around a place of a snippet; others: more secrets there."""
    t = tokens_of(snippet)
    n = len(t.start)
    if not n:
        return None
    rows = features(t, np.zeros(n, np.int64), np.full(n, n), np.full(n, file), 0, n)
    tags = np.zeros(n, np.int8)
    for s, e in [(start, end), *others]:
        inside = np.flatnonzero((t.start < e) & (t.end > s) & (s < e))
        tags[inside] = INSIDE
        tags[inside[:1]] = BEGIN
    at = int(np.searchsorted(t.start, start))
    lo = max(0, min(at - WINDOW // 2, n - WINDOW))
    tags = tags[lo : lo + WINDOW]
    if tags[0] == INSIDE:
        tags[0] = BEGIN
    return rows[lo : lo + WINDOW], tags


def places_of(text: str, clean: bool) -> list[tuple[bool, str, int, int, list[tuple[int, int]], int]]:
    """The labelled places of a text: (whether it is a secret, snippet, start, end, other secrets in it, file feature); the same on each run."""
    base = base_spans(text)
    if not base and not clean:
        return []
    rnd = random.Random(crc32(text.encode("utf-8", "replace")))
    file, out = file_feature(text), []
    secrets = [(value, end) for _, _, end, value in base]

    def cut(at: int, to: int):
        lo = max(0, at - MARGIN)
        lo = text.find(" ", lo) + 1 if lo and 0 <= text.find(" ", lo) < at else lo
        return lo, min(len(text), to + MARGIN)

    for start, _, end, value in rnd.sample(base, min(len(base), PLACES)):
        lo, hi = cut(start, end)
        near = [(s - lo, e - lo) for s, e in secrets if s >= lo and e <= hi and (s, e) != (value, end)]
        out.append((True, text[lo:hi], value - lo, end - lo, near, file))
        for _ in range(VARIANTS):
            made = "".join(rnd.choices(rnd.choice(ALPHABETS), k=rnd.choice((8, 12, 16, 20, 24, 32, 40, 48, 64))))
            quote = rnd.choice(("", '"', "'"))
            head = text[lo:start] + rnd.choice(NAMES) + rnd.choice((" = ", "=", ": ", " : ", " ")) + quote
            out.append((True, head + made + quote + text[end:hi], len(head), len(head) + len(made), [], file))
    # places without a secret: some with digits or signs, and any
    if clean:
        signs = [m.start() for m in islice(re.finditer(r"\S*+(?<=[0-9=:])\S*", text), 1000)]
        for at in [*rnd.sample(signs, min(len(signs), PLACES)), *(rnd.randrange(max(1, len(text))) for _ in range(PLACES))]:
            lo, hi = cut(at, at)
            if not any(s < hi and e > lo for s, e in secrets):
                out.append((False, text[lo:hi], at - lo, at - lo, [], file))
    return out


_PLACE = "has boolean, ord bigint, snippet string, start int, end int, others array<int>, file int"


def _sampled(batches):
    for batch in batches:
        rows = []
        for text, clean in zip(batch.column(0), batch.column(1).to_pylist()):
            for i, (has, snippet, start, end, others, file) in enumerate(places_of(text.as_py() or "", clean)):
                rows.append((has, crc32(snippet.encode("utf-8", "replace"), i), snippet, start, end, [x for o in others for x in o], file))
        kinds = [pa.bool_(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32()]
        cols = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["has", "ord", "snippet", "start", "end", "others", "file"])


def fit(docs: DataFrame, text: str = "text", most: tuple[int, int] = (TRAIN_WINDOWS, CLEAN_WINDOWS), clean_texts: int = CLEAN_TEXTS) -> Field | None:
    """A field from at most so many windows with a secret, and without; None if no text has one.

    Every text with a base span is a candidate, and about ``clean_texts`` texts by their hash for places
    without one. The windows are the first by a hash of their contents, whatever the partitions; only
    about as many as are wanted reach the driver.
    """
    n = max(docs.count(), 1)
    own = docs.select(F.col(text).alias("text"), (F.pmod(F.xxhash64(text), F.lit(n)) < clean_texts).alias("clean"))
    found = materialize(own.mapInArrow(_sampled, _PLACE), "secret-places")
    first = []
    for has, wanted in zip((True, False), most):
        wanted = wanted if has else min(wanted, CLEAN_RATIO * len(first))
        own = found.where(F.col("has") == has)
        share = min(1.0, 1.3 * wanted / max(own.count(), 1))
        first += own.where(F.col("ord") <= int(share * (1 << 32))).orderBy("ord", "snippet", "start").limit(wanted).collect()
    made = [window(r["snippet"], r["start"], r["end"], list(zip(r["others"][::2], r["others"][1::2])), r["file"]) for r in first]
    made = [m for m in made if m is not None]
    if not any((tags != OUTSIDE).any() for _, tags in made):
        return None
    rows, tags, mask = np.zeros((len(made), WINDOW, N_FEATURES), np.int32), np.zeros((len(made), WINDOW), np.int8), np.zeros((len(made), WINDOW), bool)
    for i, (r, t) in enumerate(made):
        rows[i, : len(t)], tags[i, : len(t)], mask[i, : len(t)] = r, t, True
    return train(rows, tags, mask)


# --- tagging -----------------------------------------------------------------------------


def _tokens_of_all(texts: list[str]) -> tuple[Tokens, np.ndarray]:
    """Tokens of all texts with their own places, and how many each text has; short texts are read together."""
    parts, sizes, held, length = [], np.zeros(len(texts), np.int64), [], 0

    def flush():
        starts = np.cumsum([0, *(len(texts[i]) + 1 for i in held)])
        t = _tokens("\n".join(texts[i] for i in held), 0)
        which = np.searchsorted(starts, t.start, "right") - 1
        sizes[held] = np.bincount(which, minlength=len(held))[: len(held)]
        parts.append(Tokens(t.start - starts[which], t.end - starts[which], t.word, t.shape, t.change, t.hexes, t.mark))

    for i, text in enumerate(texts):
        if held and length + len(text) > TOGETHER:
            flush()
            held, length = [], 0
        if len(text) > TOGETHER:
            parts.append(tokens_of(text))
            sizes[i] = len(parts[-1].start)
        else:
            held.append(i)
            length += len(text)
    if held:
        flush()
    return Tokens.joined(parts), sizes


def _path(scores: np.ndarray, starts: np.ndarray, field: Field) -> np.ndarray:
    """The best path. Tokens that are surely outside needn't be searched.

    Making a token outside (and begin of an inside after it) changes at most three steps. A token whose lead is larger
    than these can cost is outside in the best path, and what lies on both sides of it is independent.
    """
    finite = np.concatenate((field.steps.ravel(), field.begin))
    finite = finite[finite > NEVER / 2]
    after = np.append(np.maximum(scores[1:, INSIDE] - scores[1:, BEGIN], 0), 0)
    sure = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) > 3 * (finite.max() - finite.min()) + after + 1e-3
    kept = ~sure
    kept[:-1] |= ~sure[1:]
    kept[1:] |= ~sure[:-1]
    tags, at = np.zeros(len(scores), np.int8), np.flatnonzero(kept)
    if len(at):
        own = scores[at].astype(float)
        own[sure[at], 1:] = 100 * NEVER
        begins = starts[at] | (np.diff(at, prepend=at[0] - 2) > 1)
        tags[at] = best_path(own, begins, field.steps, field.begin)
    return tags


def tagged(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """(start, end) of what the field's best path calls a secret in each text."""
    t, sizes = _tokens_of_all(texts)
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(texts)), sizes)
    first, last = (ends - sizes)[which], ends[which]
    file = np.array([file_feature(x) for x in texts])[which]
    n = len(which)
    scores = [field.scores(features(t, first, last, file, lo, min(lo + BLOCK, n))) for lo in range(0, n, BLOCK)]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not n:
        return out
    tags = _path(np.concatenate(scores), np.arange(n) == first, field)
    begins = np.flatnonzero(tags == BEGIN)
    other = np.flatnonzero(tags != INSIDE)
    stops = np.concatenate((other, [n]))[np.searchsorted(other, begins, "right")]
    for b, e in zip(begins, stops):
        w = which[b]
        start, end = int(t.start[b]), int(t.end[min(e, last[b]) - 1])
        value = texts[w][start:end]
        start, end = start + len(value) - len(value.lstrip(".-")), end - (len(value) - len(value.rstrip(".-")))
        if end - start >= LEAST["secret"]:
            out[w].append((start, end))
    return out


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _scanner(field: Field | None):
    def rows(ids, texts):
        extra = tagged(texts, field) if field is not None else [[] for _ in texts]
        base, spans = [], []
        for text, more in zip(texts, extra):
            own = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in own])
            reach = list(accumulate((x[2] for x in own), max))
            before = [bisect_left(own, (e,)) for _, e in more]  # those that start before an end
            free = [(s, 3, e) for (s, e), i in zip(more, before) if not i or reach[i - 1] <= s]
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in sorted([(s, k, e) for s, k, e, _ in own] + free)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(base, kind), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    def run(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for i in range(batch.num_rows):
                ids.append(batch.column(0).slice(i, 1))
                texts.append(batch.column(1)[i].as_py() or "")
                size += len(texts[-1])
                if size > AT_ONCE:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)

    return run


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, base (spans of the patterns), spans (these and the field's) for each input row.

    A span is (start, kind, end), code points, end exclusive; kind indexes KINDS. The field is
    fitted on a sample of ``docs`` unless it is given; where no text holds a base span nothing can be
    learned and the base spans stay alone. A null text counts as empty; texts of any length count whole, rows of
    equal id and text get equal results, a field's span that overlaps a base span is left out. An
    empty table gives no rows; other columns are ignored.
    """
    field = field or fit(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scanner(field), f"doc_id {kind}, base {_SPANS}, spans {_SPANS}")


def told(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    """Query: secrets of every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *[number(i) for i in range(3)], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
