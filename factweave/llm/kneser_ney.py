"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is a 4-gram over code points, trained on trusted text (documents labelled
good). Every code point is a symbol of its own. Counts, continuation counts, contexts and
discounts are tables that are grouped and joined by n-gram or context, so they are
sharded over the cluster, and so is the scoring: documents are packed in chunks, each
chunk asks once for each of its distinct n-grams, those are joined with the model's
tables order by order, and the answers go back to the chunks, which add them up by
document. Neither the driver nor any task holds the model. A document is kept if its
perplexity is within its language's quantile over trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, materialize_by

ORDER = 4
#: Bits of a symbol: a code point and 1; 0 stands before a text.
BITS = 21
#: Code points there are: below unigrams, each is as likely as any other.
POINTS = 0x110000
#: Characters of a chunk, whose distinct n-grams are looked up once, and of a block of it that is handled at once.
CHUNK, BLOCK = 1 << 24, 1 << 21
#: Bits of a chunk's number within its task, and of an n-gram's place within its chunk.
TASK_BITS, PLACE_BITS = 12, 31
#: Different symbols of a block whose n-grams fit 64 bits, and characters of a block that never has more.
ALPHABET, FEW = 65_535, 65_000
#: Share of a language's trusted documents whose perplexity is within its threshold.
QUANTILE = 0.995
#: Trusted documents that a language needs for a threshold of its own.
MIN_TRUSTED = 50


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive places i..j of texts that have ``most`` characters together, or one that has more."""
    i = 0
    while i < len(sizes):
        j, size = i, 0
        while j < len(sizes) and (j == i or size + sizes[j] <= most):
            size += sizes[j]
            j += 1
        yield i, j
        i = j


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(alphabet, codes, texts): the 4-gram that ends at each symbol, as numbers of symbols in an alphabet, and the number of its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), sizes)
    padded = np.zeros(len(points) + (ORDER - 1) * len(texts), np.uint32)
    at = np.arange(len(points)) + (ORDER - 1) * (of + 1)
    padded[at] = points + 1
    used = np.zeros(POINTS + 1, bool)
    used[padded] = True
    step = len(at) if used.sum() <= ALPHABET else FEW
    for a in range(0, len(at), max(step, 1)):
        here = at[a : a + step]
        part = padded[here[0] - ORDER + 1 : here[-1] + 1]
        used[:] = False
        used[part] = used[0] = True
        alphabet = np.flatnonzero(used)
        bits = int(len(alphabet) - 1).bit_length()
        number = np.zeros(POINTS + 1, np.uint32 if ORDER * bits <= 32 else np.uint64)
        number[alphabet] = np.arange(len(alphabet))
        part, here = number[part], here - (here[0] - ORDER + 1)
        code = part[here]
        for k in range(1, ORDER):
            code |= part[here - k] << part.dtype.type(bits * k)
        yield alphabet, code, of[a : a + step]


def told(alphabet: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of codes, in the same order."""
    bits = int(len(alphabet) - 1).bit_length()
    at = lambda k: alphabet[((codes >> codes.dtype.type(bits * k)) & codes.dtype.type((1 << bits) - 1)).astype(np.int64)]
    context = np.zeros(len(codes), np.int64)
    for k in range(ORDER - 1, 0, -1):
        context = context << BITS | at(k)
    return context, at(0).astype(np.int32)


def _count(trusted: DataFrame) -> DataFrame:
    """context, symbol, c of all 4-grams of ``text``: counted in tasks, then by n-gram."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for t in b.column("text").to_pylist() if t]
            for i, j in _runs([len(t) for t in texts], BLOCK):
                for alphabet, code, _ in grams(texts[i:j]):
                    u, c = np.unique(code, return_counts=True)
                    context, symbol = told(alphabet, u)
                    yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(symbol), pa.array(c.astype(np.int64))], ["context", "symbol", "c"])

    return trusted.mapInArrow(local, "context long, symbol int, c long").groupBy("context", "symbol").agg(F.sum("c").alias("c"))


def _discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, 3 and more."""
    r = table.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (r[f"n{k}"] for k in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def _last(k: int) -> Column:
    """The last k symbols of a context."""
    return F.col("context").bitwiseAND((1 << (BITS * k)) - 1)


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]] | None:
    """For each order the n-grams (context, symbol, p) and contexts (context, back); None without text.

    ``trusted`` has a column ``text``. Each order's table is joined with its contexts
    and with the order below.
    """
    tables = {ORDER: materialize(_count(trusted), "kn-counts")}
    if tables[ORDER].isEmpty():
        return None
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols stand before
        lower = tables[k + 1].groupBy(_last(k - 1).alias("context"), "symbol").agg(F.count(F.lit(1)).alias("c"))
        tables[k] = materialize(lower, "kn-counts")
    model, below = [], None
    for k in range(1, ORDER + 1):
        d = _discounts(tables[k])
        c = F.col("c")
        discount = F.when(c == 1, F.lit(d[0])).when(c == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        many = [F.count_if(c == 1), F.count_if(c == 2), F.count_if(c > 2)]  # whole numbers: their sums don't depend on an order
        held = sum((n * F.lit(x) for n, x in zip(many, d)), F.lit(0.0))
        contexts = materialize(tables[k].groupBy("context").agg(F.sum("c").alias("total"), held.alias("held")), "kn-contexts")
        rows = tables[k].join(contexts.hint("merge"), "context").withColumn("own", (c - discount) / F.col("total")).withColumn("back", F.col("held") / F.col("total"))
        if below is None:
            p = rows.withColumn("p", F.col("own") + F.col("back") / POINTS)
        else:
            lower = below.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("q"))
            p = rows.withColumn("suffix", _last(k - 2)).join(lower.hint("merge"), ["suffix", "symbol"])
            p = p.withColumn("p", F.col("own") + F.col("back") * F.col("q"))
        below = materialize(p.select("context", "symbol", "p"), "kn-model")
        model.append((below, contexts.select("context", (F.col("held") / F.col("total")).alias("back"))))
    return model


def dense(model: list[tuple[DataFrame, DataFrame]], classes: int = 64) -> np.ndarray:
    """log p of every 4-gram of a model of few symbols, to look at it whole.

    Classes are the symbols in order, from 1; all other code points are dealt evenly over
    what is left of ``classes``. As context, class 0 is the place before a text.
    """
    local = [(g.toPandas(), c.toPandas()) for g, c in model]
    alphabet = np.sort(local[0][0]["symbol"].to_numpy())
    number = {0: 0} | {int(s): i for i, s in enumerate(alphabet, 1)}
    context = lambda x, k: sum(number[(int(x) >> (BITS * i)) & ((1 << BITS) - 1)] * classes**i for i in range(k))
    p = np.full(classes, (POINTS - len(alphabet)) / (classes - len(alphabet)) / POINTS)
    p[1 : len(alphabet) + 1] = 1 / POINTS
    for k, (found, contexts) in enumerate(local):
        back = np.ones(classes**k)
        back[[context(x, k) for x in contexts["context"]]] = contexts["back"]
        # p(context, symbol) of an unseen n-gram is the context's backoff times p of its suffix
        p = np.repeat(back, classes) * np.tile(p, classes ** (k + 1) // len(p))
        p[[context(x, k) * classes + number[int(s)] for x, s in zip(found["context"], found["symbol"])]] = found["p"]
    return np.log(p)


def _chunks(rows: DataFrame) -> DataFrame:
    """chunk, keys, sizes, text, bytes, contexts, symbols: rows (doc_id, text) packed, and the distinct n-grams of their texts in order."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << TASK_BITS
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _runs([len(t) for t in texts], CHUNK):
                own = texts[i:j]
                found = []
                for s, e in _runs([len(t) for t in own], BLOCK):
                    found += [told(alphabet, np.unique(code)) for alphabet, code, _ in grams(own[s:e])]
                context = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
                symbol = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int32)
                order = np.lexsort((symbol, context))
                context, symbol = context[order], symbol[order]
                new = np.ones(len(context), bool)
                new[1:] = (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])
                whole = "".join(own).encode("utf-8", "surrogatepass")
                lists = lambda values: pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), values)
                columns = [
                    pa.array([number]),
                    lists(b.column("doc_id").slice(i, j - i)),
                    lists(pa.array([len(t) for t in own], pa.int64())),
                    pa.array([pa.compress(whole, codec="zstd", asbytes=True)], pa.binary()),
                    pa.array([len(whole)], pa.int64()),
                    pa.array([context[new].tobytes()], pa.binary()),
                    pa.array([symbol[new].tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "keys", "sizes", "text", "bytes", "contexts", "symbols"])
                number += 1

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(packed, f"chunk long, keys array<{id_type}>, sizes array<long>, text binary, bytes long, contexts binary, symbols binary")


def _asked(chunks: DataFrame) -> DataFrame:
    """at, context, symbol: the n-grams that chunks ask for; ``at`` is the chunk and the n-gram's place in it."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, contexts, symbols in zip(b.column("chunk").to_pylist(), b.column("contexts"), b.column("symbols")):
                context, symbol = np.frombuffer(contexts.as_py(), np.int64), np.frombuffer(symbols.as_py(), np.int32)
                at = np.int64(chunk << PLACE_BITS) + np.arange(len(context))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(context), pa.array(symbol)], ["at", "context", "symbol"])

    return chunks.select("chunk", "contexts", "symbols").mapInArrow(listed, "at long, context long, symbol int")


def _answers(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """context, symbol, logp of distinct n-grams: unseen ones back off order by order."""
    p = F.lit(1 / POINTS)
    for k, (found, contexts) in enumerate(model):
        seen = found.select(F.col("context").alias(f"c{k}"), "symbol", F.col("p").alias(f"p{k}"))
        backs = contexts.select(F.col("context").alias(f"c{k}"), F.col("back").alias(f"b{k}"))
        wanted = wanted.withColumn(f"c{k}", _last(k)).join(seen.hint("merge"), [f"c{k}", "symbol"], "left").join(backs.hint("merge"), f"c{k}", "left")
        p = F.coalesce(f"p{k}", F.coalesce(F.col(f"b{k}"), F.lit(1.0)) * p)
    return wanted.select("context", "symbol", F.log(p).alias("logp"))


def perplexities(docs: DataFrame, model: list | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_symbols, perplexity for each input row; null and empty texts have none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    if not model:
        return rows.select("doc_id", F.length("text").cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("perplexity"))
    chunks = materialize_by(_chunks(rows), "kn-chunks", "chunk")  # texts wait in place for their answers
    asked = _asked(chunks)
    answers = materialize(_answers(asked.select("context", "symbol").distinct(), model), "kn-answers")
    place = F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    given = asked.join(answers.hint("merge"), ["context", "symbol"]).select(F.shiftright("at", PLACE_BITS).alias("chunk"), place.alias("no"), F.col("logp").cast("float"))

    def scored(chunk: pa.Table, given: pa.Table) -> pa.Table:
        value = lambda c: chunk.column(c)[0]
        sizes = value("sizes").values.to_numpy()
        context, symbol = np.frombuffer(value("contexts").as_py(), np.int64), np.frombuffer(value("symbols").as_py(), np.int32)
        logp = np.zeros(len(context), np.float32)
        logp[given.column("no").to_numpy()] = given.column("logp").to_numpy()
        heads = np.ones(len(context), bool)
        heads[1:] = context[1:] != context[:-1]
        contexts, key = context[heads], (np.cumsum(heads) - 1) << BITS | symbol
        whole = pa.decompress(value("text").as_py(), decompressed_size=value("bytes").as_py(), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")
        ends = np.cumsum(sizes).tolist()
        texts = [whole[e - n : e] for e, n in zip(ends, sizes.tolist())]
        total = np.zeros(len(texts))
        for i, j in _runs(sizes.tolist(), BLOCK):
            for alphabet, code, of in grams(texts[i:j]):
                u = np.unique(code)
                c, s = told(alphabet, u)
                p = logp[np.searchsorted(key, np.searchsorted(contexts, c) << BITS | s)]
                total[i:j] += np.bincount(of, weights=p[np.searchsorted(u, code)], minlength=j - i)
        ppl = pa.array(np.exp(-total / np.maximum(sizes, 1)), pa.float64(), mask=sizes == 0)
        return pa.Table.from_arrays([value("keys").values, pa.array(sizes), ppl], names=["doc_id", "n_symbols", "perplexity"])

    return chunks.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(scored, f"doc_id {id_type}, n_symbols long, perplexity double")


def thresholds(scores: DataFrame, quantile: float = QUANTILE, min_trusted: int = MIN_TRUSTED) -> DataFrame:
    """lang, own, overall: the largest perplexity that is kept, from rows (lang, perplexity) of trusted documents.

    A row for each language with enough trusted documents, however many languages there
    are, and one without a language whose ``overall`` is the quantile over all.
    """
    at = F.percentile_approx("perplexity", quantile, 10_000)
    own = scores.where("lang is not null").groupBy("lang").agg(at.alias("own"), F.count("perplexity").alias("n")).where(F.col("n") >= min_trusted)
    every = scores.agg(at.alias("overall"))
    return own.select("lang", "own", F.lit(None).cast("double").alias("overall")).unionByName(every.select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("own"), "overall"))


def judge(docs: DataFrame, labels: DataFrame | None, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept for each row of docs (doc_id, text, lang).

    Trusted are the documents whose labels (doc_id, quality) all say 1. Null and empty
    texts have no perplexity and aren't kept; without any trusted text the others
    are all kept. A perplexity equal to the threshold is kept; texts of any length count
    whole. Repeated rows are judged one by one; an empty table gives no rows; other columns
    of either table are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    good = None
    model = None
    if labels is not None:
        marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
        good = materialize(marks.where("q = 1").select("doc_id"), "kn-trusted")
        model = train(docs.join(good, "doc_id", "left_semi").where("text is not null").select("text"))
    # the language travels with the row through the scoring, packed beside the id
    packed = docs.select(F.struct("doc_id", "lang").alias("key"), "text")
    scores = perplexities(packed, model, "key").select("doc_id.doc_id", "doc_id.lang", "n_symbols", "perplexity")
    scores = materialize(scores, "kn-scores")
    if model is None:
        out = scores.withColumn("threshold", F.lit(None).cast("double"))
    else:
        limits = materialize(thresholds(scores.join(good, "doc_id", "left_semi"), quantile), "kn-limits")
        overall = F.lit(limits.where("lang is null").first()["overall"]).cast("double")
        out = scores.join(limits.where("lang is not null").select("lang", "own"), "lang", "left").withColumn("threshold", F.coalesce("own", overall)).select(*scores.columns, "threshold")
    return out.withColumn("kept", F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))) if model is not None else F.col("n_symbols") > 0)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Query: perplexity and verdict of every document; trusted are those labelled good."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
