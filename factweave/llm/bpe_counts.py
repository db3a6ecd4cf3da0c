"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer (pre-tokens by pattern, then merges by rank) is compiled
into a deterministic transducer over characters. Its transitions carry the change
that the character makes to the number of tokens so far, so a text's count is the
sum along its path. States are determinised when they are first reached: a state
holds what the pattern has open (a run of letters, digits, marks or white space, or
an apostrophe) and, of the open pre-token, the last token of each prefix that a
longer token could still reach back to.

A piece of a long text has a state map: from start state to (count, end state). It is
known in part: for the start state that the characters before the piece lead to from
anywhere (a transducer of this kind soon forgets how it began). Neighbouring maps
compose where the end state of one is the start state of the next. A scan over the
pieces of a text finds the places where it isn't, the maps of those pieces get that
start state too, and so on until all compose; then the counts add up. So a text
without white space, or of one endless run of letters, is counted in parallel as well.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import keyed, pieces_of, sliced
from .store import materialize

TOKENIZER = "byte_bpe_50k.json"
#: Characters of a piece, and of the longest text that is counted in one go.
PIECE = 1 << 15
#: Characters before a piece that lead to its likely start state.
BEFORE = 256
#: A worker's transducer starts anew when it has this many states.
MAX_STATES = 300_000
#: The pattern's contractions; fixed values of this kind of tokenizer.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_SPACE, _LETTER, _DIGIT = regex.compile(r"\s"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The vocabulary as byte strings, and which tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.made: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        for a, b in spec["model"]["merges"]:  # ids in this class: bytes first, then merges by rank
            x, y = raw(a), raw(b)
            pair = (self.ids[x], self.ids[y])
            self.made[pair] = self.ids[x + y] = len(self.parts)
            self.parts.append(pair)
        self.heads = {t[:k] for t in self.ids for k in range(1, len(t))}
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' joined bytes gives these two tokens again.

        Walks down both sides of the seam: a merge across it that would happen
        before the sides are complete rules the pair out.
        """
        key = (left, right)
        if key not in self._fits:
            self._fits[key] = self._seam_holds(left, right)
        return self._fits[key]

    def _seam_holds(self, left: int, right: int) -> bool:
        before = len(self.parts)  # merges of a lower rank than this happen while both sides stand
        while True:
            if self.made.get((left, right), before) < before:
                return False
            undo_left = left > right
            side = left if undo_left else right
            if self.parts[side] is None:
                # the younger side is a single byte, and so is the other: nothing is left to undo
                return True
            # undo the younger side; until it was made, only earlier merges could cross the seam
            before = side if undo_left else side + 1
            if undo_left:
                left = self.parts[left][1]
            else:
                right = self.parts[right][0]


class _State(dict):
    """Transitions by character: (change in tokens, next state); built when first used."""

    __slots__ = ("maker", "open")

    def __init__(self, maker: Transducer, opened: tuple):
        self.maker, self.open = maker, opened

    def __missing__(self, char: str):
        self[char] = found = self.maker.step(self.open, char)
        return found


class Transducer:
    """The tokenizer as a transducer; ``count`` runs it over a text."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self.states: dict[tuple, _State] = {}
        self.kinds: dict[str, str] = {}
        self.special = re.compile("|".join(map(re.escape, merges.specials))) if merges.specials else None

    def state(self, opened: tuple) -> _State:
        if opened not in self.states:
            self.states[opened] = _State(self, opened)
        return self.states[opened]

    def kind(self, char: str) -> str:
        """W white space, L letter, N number, O other."""
        if char not in self.kinds:
            self.kinds[char] = "W" if _SPACE.match(char) else "L" if _LETTER.match(char) else "N" if _DIGIT.match(char) else "O"
        return self.kinds[char]

    # The open part of a state: () at a pre-token's start; (kind, inner) in a run;
    # ("W", inner, change, char) in white space, with what its last character changed;
    # ("A", so far) after an apostrophe that may start a contraction.

    def step(self, opened: tuple, char: str) -> tuple[int, _State]:
        if not opened:
            return self._fresh(char)
        kind = self.kind(char)
        if opened[0] == "A":
            so_far = opened[1] + char
            had = self._size(opened[1][:1]) + self._size(opened[1][1:])
            if so_far in CONTRACTIONS:
                return self._size(so_far) - had, self.state(())
            if len(so_far) == 2 and any(c.startswith(so_far) for c in CONTRACTIONS):
                return self._size(char), self.state(("A", so_far))
            run = ("O", self._run((), "'")[1]) if len(opened[1]) == 1 else ("L", self._run((), opened[1][1])[1])
            return self.step(run, char)
        if opened[0] == "W":
            _, inner, last, white = opened
            if kind == "W":
                change, inner = self._run(inner, char)
                return change, self.state(("W", inner, change, char))
            if white == " ":  # the last blank moves to the next pre-token
                change, inner = self._run((), " " + char)
                return change - last, self.state((kind, inner))
            change, found = self._fresh(char)  # the last white character stands alone
            return change + self._size(white) - last, found
        if kind == opened[0]:
            change, inner = self._run(opened[1], char)
            return change, self.state((kind, inner))
        return self._fresh(char)

    def _fresh(self, char: str) -> tuple[int, _State]:
        kind = self.kind(char)
        change, inner = self._run((), char)
        if kind == "W":
            return change, self.state(("W", inner, change, char))
        return change, self.state(("A", "'") if char == "'" else (kind, inner))

    def _size(self, text: str) -> int:
        return self._run((), text)[0]

    def _run(self, inner: tuple, text: str) -> tuple[int, tuple]:
        """Reads bytes of one pre-token: the change in tokens and the new inner state.

        inner is (suffix, lasts, counts): the longest suffix that a longer token could
        contain, and for each position in it the token that ends there and the tokens
        so far less those at its end. () is the empty pre-token.
        """
        ids, fits, heads = self.merges.ids, self.merges.fits, self.merges.heads
        suffix, lasts, counts = inner or (b"", (None,), (0,))
        change = 0
        for b in text.encode("utf-8", "surrogatepass"):
            suffix += bytes([b])
            for at, last in enumerate(lasts):  # the longest token that suits what stands before it
                token = ids.get(suffix[at:])
                if token is not None and (last is None or fits(last, token)):
                    break
            gained = counts[at] + 1
            change += gained
            counts = (*(c - gained for c in counts), 0)
            lasts += (token,)
            drop = 0
            while drop < len(suffix) and suffix[drop:] not in heads:
                drop += 1
            suffix, lasts, counts = suffix[drop:], lasts[drop:], counts[drop:]
        return change, (suffix, lasts, counts)

    def count(self, text: str) -> int:
        """Tokens of a whole text; special tokens in it count one each."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count_plain, parts))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        if len(self.states) > self.max_states:
            self.states.clear()
        return self.run((), text)[0]

    def run(self, opened: tuple, text: str) -> tuple[int, tuple]:
        """The tokens that a text adds from a start state, and the end state."""
        state, n = self.state(opened), 0
        for char in text:
            change, state = state[char]
            n += change
        return n, state.open


def likely_start(t: Transducer, before: str) -> tuple:
    """The state after the characters before a piece, read from the beginning of a pre-token."""
    return t.run((), before)[1]


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker process and file."""
    if path not in _made:
        _made[path] = Transducer(Merges(path))
    return _made[path]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE, before: int = BEFORE) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each input row.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length are read
    whole, those beyond ``piece`` characters in pieces. Repeated rows give a row each;
    an empty table gives no rows; other columns are ignored.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    rows = keyed(docs, doc_id, text, piece)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in sliced(batches):
            n = pa.array([t.count(x) for x in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    few = sized.where("__key is null").select("doc_id", "text", "n_bytes").mapInArrow(short, f"doc_id {id_type}, n_bytes long, n_tokens long")
    many = sized.where("__key is not null").select("doc_id", "n_bytes", "__key").join(_long_counts(rows, path, piece, before), "__key")
    return few.unionByName(many.select("doc_id", "n_bytes", "n_tokens"))


def _long_counts(rows: DataFrame, path: str, piece: int, before: int) -> DataFrame:
    """__key, n_tokens of each distinct long text."""
    specials = Merges(path).specials
    # a special token splits a text before the tokenizer sees it; pieces are cut inside these sections
    mark = "|".join(re.escape(s) for s in specials) or r"\z(?!\z)"
    sections = (
        rows.where("__key is not null")
        .dropDuplicates(["__key"])
        .select(F.col("__key").alias("__text"), F.posexplode(F.split("text", mark)).alias("section", "text"))
        .withColumn("__key", F.concat_ws(":", "__text", "section"))
    )
    schema = "__key string, no int, begin string, n long, end string"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in sliced(batches, 64):
            found = []
            for part, head, given in zip(*(b.column(c).to_pylist() for c in ("part", "head", "begin"))):
                if len(t.states) > t.max_states:
                    t.states.clear()
                begin = ast.literal_eval(given) if given is not None else likely_start(t, head)
                n, end = t.run(begin, part)
                found.append((repr(begin), n, repr(end)))
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("__key"), b.column("no"), *cols], ["__key", "no", "begin", "n", "end"])

    parts = pieces_of(sections.where("text <> ''"), piece, before)
    maps = materialize(parts.withColumn("begin", F.lit(None).cast("string")).mapInArrow(mapped, schema), "tokens-maps")
    while True:
        reached = F.lag("end").over(Window.partitionBy("__key").orderBy("no"))
        apart = materialize(maps.withColumn("reached", reached).where("reached <> begin").select("__key", "no", F.col("reached").alias("begin")), "tokens-apart")
        if apart.isEmpty():
            break
        again = parts.join(apart, ["__key", "no"]).mapInArrow(mapped, schema)
        maps = materialize(maps.join(apart, ["__key", "no"], "left_anti").unionByName(again), "tokens-maps")
    plain = maps.groupBy(F.substring_index("__key", ":", 1).alias("__key")).agg(F.sum("n").alias("n"))
    extra = sections.groupBy(F.col("__text").alias("__key")).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.join(plain, "__key", "left").select("__key", (F.coalesce("n", F.lit(0)) + F.col("extra")).cast("long").alias("n_tokens"))


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    """Query: bytes and tokens of every document, and whether it exceeds 512 tokens."""
    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
