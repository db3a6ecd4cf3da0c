"""Substring dedup: passages that occur earlier in the corpus are cut out.

A window of 20 words is removed wherever the same words start earlier. Windows are
dealt to shards by content: each window has an anchor, the smallest hash among the
8-word sequences in it, so equal windows have equal anchors and meet in one shard.
Neighbouring windows with the same anchor form one segment of the document.

1. Anchors alone are shuffled; those that occur once in the corpus are dropped.
2. For the others, segments go to the shards. A task sends equal segments once, with
   their earliest place, so a passage that a third of all documents share reaches a
   shard once for each task.
3. A shard builds a compressed FM-index of its distinct segments. The documents'
   windows are streamed through it by backward search; a window's range in the
   suffix array holds all its occurrences, and its interval is reported if the
   earliest of them is another one.
4. Intervals meet their documents again, and the words they cover are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .jaccard_join import WordHashes, mix
from .store import materialize

WINDOW = 20
#: Words of the sequences among which a window's anchor is chosen.
ANCHOR = 8
#: Text bytes for each shard.
SHARD_BYTES = 16 << 20
#: Words handled at once in a task.
BLOCK_WORDS = 1 << 20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_hashes = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: bytes.split() without argument splits at the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Block:
    """Word hashes of some documents, one after another, and their anchored segments."""

    def __init__(self, docs: list[list[bytes]]):
        sizes = np.array([len(w) for w in docs], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.first[-1])
        self.hash = np.fromiter((_hashes[w] for words in docs for w in words), np.uint64, n)
        m = n - WINDOW + 1
        if m <= 0:
            self.anchor = np.zeros(0, np.uint64)
            self.doc = self.start = self.count = self.at = np.zeros(0, np.int64)
            return
        grams = n - ANCHOR + 1
        g = self.hash[:grams].copy()
        for j in range(1, ANCHOR):
            g = mix(g * _M1 + self.hash[j : j + grams])
        best, where = g, np.arange(grams)
        span, width = 1, WINDOW - ANCHOR + 1
        while span < width:  # leftmost smallest of `span` neighbours, doubled up to `width`
            step = min(span, width - span)
            take = best[:-step] <= best[step:]
            best, where = np.where(take, best[:-step], best[step:]), np.where(take, where[:-step], where[step:])
            span += step
        doc = np.searchsorted(self.first, np.arange(m), "right") - 1
        inside = np.arange(m) + WINDOW <= self.first[doc + 1]
        start = np.flatnonzero(inside)
        doc, where = doc[start], where[start]
        new = np.ones(len(start), bool)
        new[1:] = (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(new)
        self.anchor = g[where[heads]]
        self.doc = doc[heads]
        self.at = where[heads] - self.first[self.doc]  # the anchor's place in its document
        self.start = start[heads] - self.first[self.doc]  # first window of the segment
        self.count = np.diff(np.append(heads, len(start)))  # windows

    def words(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the picked segments' words, where each segment begins)."""
        size = self.count[pick] + WINDOW - 1
        begins = np.concatenate([[0], np.cumsum(size)[:-1]])
        index = np.arange(int(size.sum())) - np.repeat(begins, size) + np.repeat(self.start[pick] + self.first[self.doc[pick]], size)
        return self.hash[index], begins


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Slices of a batch with about BLOCK_WORDS words: (from row, to row, words of each)."""
    docs, start, size = [], 0, 0
    for i, t in enumerate(batch.column("text")):
        docs.append(words_of(t.as_py()))
        size += len(docs[-1])
        if size >= BLOCK_WORDS or i == batch.num_rows - 1:
            yield start, i + 1, docs
            docs, start, size = [], i + 1, 0


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1 if len(order) else []
    start = 0
    for e in ends:
        yield int(bucket[order[start]]), order[start:e]
        start = e


def _grouped(d: np.ndarray, t: np.ndarray, *values: np.ndarray) -> pd.DataFrame:
    """A row for each (d, t) with its int32 values, row by row, as bytes."""
    order = np.lexsort((t, d))
    d, t = d[order], t[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    heads = np.flatnonzero(new)
    packed = np.stack([v[order].astype(np.int32) for v in values], 1)
    ends = np.append(heads[1:], len(d)).tolist()
    return pd.DataFrame({"d": d[heads], "t": t[heads], "found": [packed[a:e].tobytes() for a, e in zip(heads.tolist(), ends)]})


def _unpacked(pdf: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in pdf[name]]) if len(pdf) else np.zeros(0, kind)


def _repeated_anchors(rows: DataFrame, shards: int) -> DataFrame:
    """d, t, found (int32 places of anchors that occur more than once)."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor of a block once, and the places of those that the block has twice."""
        for b in batches:
            d, t = b.column("d").to_numpy(), b.column("t").to_numpy()
            out: list[tuple] = []
            for lo, _, docs in _blocks(b):
                x = Block(docs)
                order = np.argsort(x.anchor, kind="stable")
                value = x.anchor[order]
                head = np.ones(len(value), bool)
                head[1:] = value[1:] != value[:-1]
                often = np.zeros(len(value), bool)
                often[:-1] |= ~head[1:]
                often |= ~head
                for k, at in _by_bucket((value % np.uint64(shards)).astype(np.int64)):
                    one, many = at[head[at]], at[often[at]]
                    i, j = order[one], order[many]
                    out.append((
                        k, value[one].tobytes(), often[one].tobytes(), d[lo + x.doc[i]].tobytes(), t[lo + x.doc[i]].tobytes(), x.at[i].astype(np.int32).tobytes(),
                        d[lo + x.doc[j]].tobytes(), t[lo + x.doc[j]].tobytes(), x.at[j].astype(np.int32).tobytes(),
                    ))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    names = ["bucket", "value", "often", "d", "t", "at", "d2", "t2", "at2"]

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        value, often = _unpacked(pdf, "value", np.uint64), _unpacked(pdf, "often", bool)
        order = np.argsort(value, kind="stable")
        v = value[order]
        twice = np.zeros(len(v), bool)
        twice[1:] |= v[1:] == v[:-1]
        twice[:-1] |= v[1:] == v[:-1]
        single = order[twice & ~often[order]]  # what the block has twice it has told itself
        d, t, at = (np.concatenate([_unpacked(pdf, c, k)[single], _unpacked(pdf, f"{c}2", k)]) for c, k in (("d", np.int64), ("t", np.int64), ("at", np.int32)))
        return _grouped(d, t, at)

    schema = "bucket long, " + ", ".join(f"{c} binary" for c in names[1:])
    found = rows.select("d", "t", "text").mapInArrow(sent, schema).groupBy("bucket").applyInPandas(met, "d long, t long, found binary")
    return found.groupBy("d", "t").agg(F.collect_list("found").alias("found"))  # of one document


def _repeated_windows(marked: DataFrame, shards: int) -> DataFrame:
    """d, t, found (int32 pairs: first word, end) of windows whose words start earlier elsewhere."""
    names = ["bucket", "key", "d", "t", "start", "count", "words", "d2", "t2", "start2", "count2"]
    kinds = {"key": np.uint64, "d": np.int64, "t": np.int64, "start": np.int32, "count": np.uint8, "words": np.uint32}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each segment of a block once, from its earliest place; the other places are repeats already."""
        for b in batches:
            d, t = b.column("d").to_numpy(), b.column("t").to_numpy()
            found = b.column("found")
            out: list[tuple] = []
            for lo, hi, docs in _blocks(b):
                x = Block(docs)
                marks = [np.unique(np.concatenate([np.frombuffer(y, np.int32) for y in found[i].as_py()])) for i in range(lo, hi)]
                mark = np.concatenate([m + x.first[k] for k, m in enumerate(marks)])
                pick = np.flatnonzero(np.isin(x.at + x.first[x.doc], mark))
                if not len(pick):
                    continue
                words, begins = x.words(pick)
                size = x.count[pick] + WINDOW - 1
                place = (np.arange(len(words)) - np.repeat(begins, size)).astype(np.uint64)
                key = mix(np.add.reduceat(mix(words + place * _M1), begins) ^ x.anchor[pick])
                dd, tt = d[lo + x.doc[pick]], t[lo + x.doc[pick]]
                order = np.lexsort((x.start[pick], tt, dd, key))
                head = np.ones(len(order), bool)
                head[1:] = key[order][1:] != key[order][:-1]
                shard = ((x.anchor[pick] >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
                short = words.astype(np.uint32)
                for k, at in _by_bucket(shard[order]):
                    one, more = order[at[head[at]]], order[at[~head[at]]]
                    index = np.concatenate([np.arange(begins[i], begins[i] + size[i]) for i in one])
                    column = lambda i: [dd[i].tobytes(), tt[i].tobytes(), x.start[pick[i]].astype(np.int32).tobytes(), x.count[pick[i]].astype(np.uint8).tobytes()]  # noqa: B023, E731
                    out.append((k, key[one].tobytes(), *column(one), short[index].tobytes(), *column(more)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    def searched(pdf: pd.DataFrame) -> pd.DataFrame:
        get = {c: _unpacked(pdf, c, k) for c, k in kinds.items()}
        done = {c: _unpacked(pdf, f"{c}2", kinds[c]) for c in ("d", "t", "start", "count")}
        size = get["count"].astype(np.int64) + WINDOW - 1
        begins = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = np.lexsort((get["start"], get["t"], get["d"], get["key"]))
        head = np.ones(len(order), bool)
        head[1:] = get["key"][order][1:] != get["key"][order][:-1]
        one, more = order[head], order[~head]
        # the distinct segments as one text of dense symbols, 0 between them
        index = np.repeat(begins[one], size[one] + 1) + np.arange(int((size[one] + 1).sum())) - np.repeat(np.cumsum(size[one] + 1) - size[one] - 1, size[one] + 1)
        last = np.cumsum(size[one] + 1) - 1
        _, symbol = np.unique(get["words"], return_inverse=True)
        text = np.append(symbol + 1, 0)[np.minimum(index, len(symbol))]
        text[last] = 0
        heads = last - size[one]
        fm = FMIndex(text, WINDOW + 1)
        n = get["count"][one].astype(np.int64)
        of = np.repeat(np.arange(len(one)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        low = fm.lower(text, heads[of] + step, WINDOW)
        d, t, start = get["d"][one][of], get["t"][one][of], get["start"][one][of].astype(np.int64) + step
        # windows in one range are equal; all but the earliest of a range are repeats
        first = np.lexsort((start, t, d, low))
        repeat = np.zeros(len(first), bool)
        repeat[1:] = low[first][1:] == low[first][:-1]
        again = first[repeat]
        parts = [
            (d[again], t[again], start[again], start[again] + WINDOW),
            *((x["d"][i], x["t"][i], x["start"][i].astype(np.int64), x["start"][i] + x["count"][i].astype(np.int64) + WINDOW - 1) for x, i in ((get, more), (done, slice(None)))),
        ]
        return _grouped(*(np.concatenate(c) for c in zip(*parts)))

    schema = "bucket long, " + ", ".join(f"{c} binary" for c in names[1:])
    found = marked.select("d", "t", "text", "found").mapInArrow(sent, schema).groupBy("bucket").applyInPandas(searched, "d long, t long, found binary")
    return found.groupBy("d", "t").agg(F.collect_list("found").alias("cuts"))  # of one document


def _kept(words: list[bytes], cuts: list[bytes] | None) -> tuple[int, bytes]:
    """(words removed, the others joined by a space)."""
    if not cuts:
        return 0, b" ".join(words)
    spans = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in cuts])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    return int(len(words) - keep.sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", contents: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null if not ``contents``), kept_sha256 for each input row.

    doc_id is an integer; documents come in its order, a null id last, equal ids by a
    hash of their texts; rows equal in both are one document and get equal results. A null text has
    no words. Texts of any length count whole; an empty table gives no rows; other
    columns are ignored.
    """
    id_type = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    volume = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(16, volume // SHARD_BYTES)
    anchors = _repeated_anchors(rows, shards)
    joined = rows.join(anchors, ["d", "t"], "left").select("doc_id", "d", "t", "text", "found")

    def told(b: pa.RecordBatch, cuts: str | None) -> list[pa.Array]:
        n, removed, texts, digests = [], [], [], []
        for i, x in enumerate(b.column("text")):
            words = words_of(x.as_py())
            gone, kept = _kept(words, b.column(cuts)[i].as_py() if cuts else None)
            n.append(len(words))
            removed.append(gone)
            texts.append(kept.decode("utf-8", "surrogatepass") if contents else None)
            digests.append(hashlib.sha256(kept).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string())]

    result = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    result_schema = "n_words long, n_removed long, kept_text string, kept_sha256 string"

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without repeated anchors are done; the others go on with their texts."""
        for b in batches:
            open_ = b.column("found").is_valid()
            done, go = b.filter(pc.invert(open_)), b.filter(open_)
            none = [pa.nulls(go.num_rows, k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*go.columns, *none], [*go.schema.names, *result])
            empty = [pa.nulls(done.num_rows, b.schema.field(c).type) for c in ("text", "found")]
            yield pa.RecordBatch.from_arrays([*(done.column(c) for c in ("doc_id", "d", "t")), *empty, *told(done, None)], [*go.schema.names, *result])

    half = materialize(joined.mapInArrow(settled, f"doc_id {id_type}, d long, t long, text string, found array<binary>, {result_schema}"), "cut-half")
    marked = half.where("found is not null")
    cuts = _repeated_windows(marked.dropDuplicates(["d", "t"]), shards)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *told(b, "cuts")], ["doc_id", *result])

    rest = marked.select("doc_id", "d", "t", "text").join(cuts, ["d", "t"], "left").select("doc_id", "text", "cuts")
    rest = rest.mapInArrow(finished, f"doc_id {id_type}, {result_schema}")
    return half.where("found is null").select("doc_id", *result).unionByName(rest)


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """Query: words that every document keeps when passages of 20 words that start earlier are cut."""
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), contents=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
