"""Phrase collocation mining: frequent word sequences by level-wise passes, scored by their weakest cut.

Words are counted first. Every frequent word gets an id, and the texts become rows of ids
with a 0 wherever a phrase can't go on (a rare word, the end of a piece). From then on a level
holds, at each position, the id of the frequent k-gram that starts there: a (k+1)-gram can
be frequent only where two neighbouring positions both have one, and the pair of their ids
says exactly which it is. So each level is a pass that counts such pairs (added up within
tasks before they are shuffled), and a pass that replaces frequent pairs by their ids.

Level tables travel as broadcast variables while they have at most ``BROADCAST`` entries and
``BROADCAST_CHARS`` characters of words, sizes that are counted before; larger ones are joined by
key instead (``_by_join``), with the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

SUPPORT, MOST_WORDS, TOP = 100, 5, 2000
#: What is broadcast at most.
BROADCAST, BROADCAST_CHARS = 500_000, 16_000_000
#: Words in a row of ids; texts are read in slices of so many bytes.
CHUNK, SLICE = 1024, 1 << 20
#: Partial counts and ids that a task holds before it passes them on.
HELD = 100_000
#: Ids of a batch that are paired at once.
AT_ONCE = 1 << 18
#: Partitions of a language that are ranked before they meet.
SALTS = 64

#: A byte that UTF-8 never has marks the end of a piece.
_END = b"\xff"
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")


def slices(text: str | None, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text in lower case, with an end mark between pieces, a bounded slice at a time."""
    data = (text or "").encode("utf-8", "replace").lower().translate(_TABLE)  # bytes: only A-Z change
    at = 0
    while at < len(data):
        cut = at + size
        if cut < len(data):
            ends = [i for i in (data.find(b" ", cut), data.find(_END, cut)) if i >= 0]
            cut = min(ends) + 1 if ends else len(data)
        yield data[at:cut].replace(_END, b" \xff ").split()
        at = cut


def _count_words(batches):
    held: dict[str, Counter] = {}

    def out():
        rows = [(lang, w.decode(), n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = held.setdefault(lang, Counter())
            for words in slices(text.as_py()):
                counts.update(words)
            counts.pop(_END, None)
            if sum(map(len, held.values())) > HELD:
                yield out()
    if held:
        yield out()


class _Ids(dict):
    """0 for every word that has no id."""

    def __missing__(self, word):
        return 0


def _joined_zeros(ids: np.ndarray) -> np.ndarray:
    """Runs of zeros become one."""
    return ids[(ids != 0) | (np.concatenate(([1], ids[:-1])) != 0)]


def _chunks(ids: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of ids with their number of starting positions; the words after those complete their phrases."""
    for at in range(0, len(ids), chunk):
        row = ids[at : at + chunk + MOST_WORDS - 1]
        core = min(chunk, len(row))
        if ((row[:-1] != 0) & (row[1:] != 0))[:core].any():
            yield row, core


def _rows(values: list[np.ndarray], cores: list[int]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())), pa.array(cores, pa.int32())], ["ids", "core"])


_CODED = "ids array<bigint>, core int"


def _coder(table, chunk: int):
    """Texts to rows of word ids, by a broadcast table."""

    def run(batches):
        lookup: dict[str, _Ids] = {}
        for lang, word, number in zip(*table.value):
            lookup.setdefault(lang, _Ids())[word.encode()] = number
        values, cores, held = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in lookup:
                    continue
                get = lookup[lang].__getitem__
                ids = [np.fromiter(map(get, words), np.int64, len(words)) for words in slices(text.as_py())]
                for row, core in _chunks(_joined_zeros(np.concatenate(ids)), chunk) if ids else ():
                    values.append(row)
                    cores.append(core)
                    held += len(row)
                    if held > HELD:
                        yield _rows(values, cores)
                        values, cores, held = [], [], 0
        if values:
            yield _rows(values, cores)

    return run


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """The batches, in slices of rows with a bounded number of ids."""
    for batch in batches:
        rows = max(1, AT_ONCE // (CHUNK + MOST_WORDS))
        ends = np.asarray(batch.column(0).offsets, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + rows, int(np.searchsorted(ends, ends[at] + AT_ONCE, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _pairs(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and the two ids of all neighbouring ids of a batch of rows."""
    ids, core = batch.column(0), np.asarray(batch.column(1))
    ends = np.asarray(ids.offsets, dtype=np.int64)
    flat = np.asarray(ids.values)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    row = np.repeat(np.arange(len(core)), np.diff(ends))
    at = np.arange(len(flat)) - ends[row]
    both = np.flatnonzero((flat[:-1] != 0) & (flat[1:] != 0) & (row[:-1] == row[1:]))
    return row[both], at[both], flat[both], flat[both + 1]


def _added_up(a: np.ndarray, b: np.ndarray, n: np.ndarray):
    ia, ua = pd.factorize(a)
    ib, ub = pd.factorize(b)
    which, pairs = pd.factorize(ia * np.int64(max(len(ub), 1)) + ib)
    return ua[pairs // max(len(ub), 1)], ub[pairs % max(len(ub), 1)], np.bincount(which, n, len(pairs)).astype(np.int64)


def _count_pairs(batches):
    held, size = [], 0
    for batch in _parts(batches):
        row, at, a, b = _pairs(batch)
        starts = at < np.asarray(batch.column(1))[row]
        held.append(_added_up(a[starts], b[starts], np.ones(starts.sum())))
        size += len(held[-1][0])
        if size > HELD:
            held = [_added_up(*map(np.concatenate, zip(*held)))]
            size = len(held[0][0])
            if size > HELD // 2:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["a", "b", "n"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _added_up(*map(np.concatenate, zip(*held))))), ["a", "b", "n"])


def _recoder(table):
    """Rows of k-gram ids to rows of (k+1)-gram ids, by a broadcast table of pairs."""

    def run(batches):
        a, b, number = table.value
        ua, ub = np.unique(a), np.unique(b)
        keys = np.searchsorted(ua, a) * np.int64(len(ub)) + np.searchsorted(ub, b)
        order = np.argsort(keys)
        keys, number = keys[order], number[order]

        def place(values, among):
            at = np.minimum(np.searchsorted(among, values), len(among) - 1)
            return at, among[at] == values

        for batch in _parts(batches):
            row, at, x, y = _pairs(batch)
            ix, in_a = place(x, ua)
            iy, in_b = place(y, ub)
            found, known = place(ix * np.int64(len(ub)) + iy, keys)
            hit = known & in_a & in_b
            row, at, found = row[hit], at[hit], number[found[hit]]
            cores = np.asarray(batch.column(1))
            bounds = np.searchsorted(row, np.arange(len(cores) + 1))
            values, left = [], []
            for r in np.flatnonzero(np.diff(bounds) > 1):  # one alone has no neighbour
                s = slice(bounds[r], bounds[r + 1])
                made = np.zeros(at[s][-1] + 1, np.int64)
                made[at[s]] = found[s]
                values.append(made)
                left.append(int(cores[r]))
            if values:
                yield _rows(values, left)

    return run


def _placed(batches):
    """Rows of (core, [(i, id)]) as rows of ids."""
    for batch in batches:
        values, cores = [], []
        for core, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            made = np.zeros(max(x["i"] for x in found) + 1, np.int64)
            made[[x["i"] for x in found]] = [x["id"] for x in found]
            values.append(made)
            cores.append(core)
        yield _rows(values, cores)


def _by_join(items: DataFrame, level: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ids where the level's table is too large to broadcast. items: row, core, i and the keys of each position.

    A row has at most CHUNK and four positions, so what meets in a group is bounded; a
    frequent key's positions are split by the skew join.
    """
    found = items.join(level.select(*keys, "id"), keys).groupBy("row").agg(F.first("core").alias("core"), F.collect_list(F.struct("i", "id")).alias("found"))
    return found.select("core", "found").mapInArrow(_placed, _CODED)


def _worded(chunk: int):
    """Texts to rows of words, "" for the end of a piece."""

    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tail: list[str] = []
                extra = MOST_WORDS - 1

                def row(words, core):
                    return pa.RecordBatch.from_pylist([{"lang": lang, "words": words, "core": core}], pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("core", pa.int32())]))

                for words in slices(text.as_py()):
                    tail += ["" if w == _END else w.decode() for w in words]
                    while len(tail) > chunk + extra:
                        yield row(tail[: chunk + extra], chunk)
                        tail = tail[chunk:]
                if tail:
                    yield row(tail, min(len(tail), chunk)) if len(tail) <= chunk else row(tail, chunk)
                    if len(tail) > chunk:
                        yield row(tail[chunk:], len(tail) - chunk)

    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, most: int = BROADCAST, chars: int = BROADCAST_CHARS, chunk: int = CHUNK) -> tuple[list[DataFrame], DataFrame]:
    """Level tables (index k - 1: the frequent phrases of k words) and the words of each language (lang, n).

    A level has lang, id, phrase, last (its last word), pre and suf (counts of its first and of its last 1 to k
    words) and, from two words on, a and b, the ids of the phrases without the last and the first word.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = materialize(texts.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrases-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    of = F.array("n")
    level = counts.where(F.col("n") >= support).select("lang", (F.monotonically_increasing_id() + 1).alias("id"), F.col("word").alias("phrase"), F.col("word").alias("last"), of.alias("pre"), of.alias("suf"))
    levels = [materialize(level, "phrases-1")]
    coded = None
    for k in range(2, MOST_WORDS + 1):
        before = levels[-1]
        size = before.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).first()
        if size["n"] == 0:
            break
        small = size["n"] <= most
        if k == 2 and small and size["chars"] <= chars:
            table = before.select("lang", "phrase", "id").toPandas()
            coded = texts.mapInArrow(_coder(spark.sparkContext.broadcast([table[c].tolist() for c in table]), chunk), _CODED)
        elif k == 2:
            rows = materialize(texts.mapInArrow(_worded(chunk), "lang string, words array<string>, core int").withColumn("row", F.monotonically_increasing_id()), "phrases-rows")
            items = rows.select("row", "core", "lang", F.posexplode("words").alias("i", "phrase")).where("phrase <> ''")
            coded = _by_join(items, before, ["lang", "phrase"])
        elif small:
            table = before.select("a", "b", "id").toPandas()
            coded = coded.mapInArrow(_recoder(spark.sparkContext.broadcast([table[c].to_numpy() for c in table])), _CODED)
        else:
            rows = materialize(coded.withColumn("row", F.monotonically_increasing_id()), "phrases-rows")
            items = rows.select("row", "core", F.posexplode(F.zip_with(F.slice("ids", 1, F.size("ids") - 1), F.slice("ids", 2, F.size("ids")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "x"))
            coded = _by_join(items.select("row", "core", "i", "x.a", "x.b").where("a <> 0 and b <> 0"), before, ["a", "b"])
        coded = materialize(coded, "phrases-ids")
        pairs = coded.mapInArrow(_count_pairs, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
        first = before.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), "pre")
        rest = before.select(F.col("id").alias("b"), "last", "suf")
        made = pairs.join(first, "a").join(rest, "b")
        levels.append(materialize(made.select(
            "lang", (F.monotonically_increasing_id() + 1).alias("id"), F.concat_ws(" ", "head", "last").alias("phrase"), "last",
            F.array_append("pre", F.col("n")).alias("pre"), F.array_append("suf", F.col("n")).alias("suf"), "a", "b"), f"phrases-{k}"))
    return levels, totals


def weakest_cut(pre, suf, a, n):
    """Struct of score, cut, l, r: the lowest floor(1000 a n / (l r)) of all cuts, the first of equal ones.

    Decimals of 38 digits hold the products exactly.
    """
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = wide(a, 18) * F.lit(1000) * wide(n, 16)

    def cut(j):
        left, right = F.get(pre, j - 1), F.get(suf, F.size(suf) - j - 1)
        score = F.call_function("div", above, wide(left, 18) * wide(right, 18))
        return F.struct(score.cast("long").alias("score"), j.cast("long").alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(pre) - 1), cut))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: each language's first ``top`` phrases of 2 to 5 words.

    A phrase that a longer one of the same count holds goes. Null texts count as empty, a null lang as "und"; texts
    of any length count whole, repeated rows each. Ties go by count, then by the phrase's bytes. An
    empty table, or one without frequent phrases, gives no rows; other columns are ignored.
    """
    levels, totals = frequent_phrases(docs, text, lang, support, **options)
    scored = None
    for level, above in zip(levels[1:], [*levels[2:], None]):
        rows = level.withColumn("a", F.element_at("pre", -1))
        if above is not None:
            inside = above.select(F.explode(F.array("a", "b")).alias("id"), F.element_at("pre", -1).alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            rows = rows.join(inside, "id", "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
        rows = rows.select("lang", "phrase", "a", "pre", "suf")
        scored = rows if scored is None else scored.unionByName(rows)
    if scored is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint, cut bigint")
    cuts = scored.join(totals, "lang").select("lang", "phrase", "a", "n", weakest_cut(F.col("pre"), F.col("suf"), F.col("a"), F.col("n")).alias("c"))
    rows = cuts.select("lang", "phrase", "a", "n", "c.*").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked(ranked(rows, "lang", "salt"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """Query: collocations of each language over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows in DuckDB's SQL, straight from the definition.
ORACLE = r"""with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
f as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f from s, range(1, 6) t(k) where i + k - 1 <= len(ws) group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
h as (select lang, k, phrase, f from f where f >= 100),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from h where k >= 2),
cuts as (select c.*, j, x.f as l, y.f as r, n.n, (1000::hugeint * a * n.n) // (x.f::hugeint * y.f) as score from c join range(1, 5) t(j) on j < k join n on n.lang = c.lang
  join h x on x.lang = c.lang and x.phrase = array_to_string(ws[1:j], ' ') and x.k = j join h y on y.lang = c.lang and y.phrase = array_to_string(ws[j + 1:], ' ') and y.k = c.k - j),
best as (select *, row_number() over (partition by lang, phrase order by score, j) as b from cuts),
kept as (select * from best where b = 1 and not exists (select 1 from c longer where longer.lang = best.lang and longer.k > best.k and longer.a >= best.a and contains(' ' || longer.phrase || ' ', ' ' || best.phrase || ' '))),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score, j::bigint as cut from ranked where rank <= 2000"""
