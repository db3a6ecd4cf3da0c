"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of a fixed length. Filters of several
widths slide over a window (their weights are one value for each byte, position and
filter: a convolution of one-hot bytes), each filter's largest response over the
window is kept, and a softmax layer turns these into one probability for each
language. A text's probabilities are the mean over all its windows, weighted by
their bytes. Trained in numpy on a bounded sample of labelled rows; applied to whole
texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Windows that training sees at most (but a text of each language); each sampled text gives up to three.
TRAIN_WINDOWS = 12_000
#: Windows scored at once.
BLOCK = 512


@dataclass
class Network:
    """tables[width][k]: (256, filters) weights of the k-th byte under a filter."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter, at least 0, and where it is."""
        best, where = [], []
        for w, t in self.tables.items():
            span = x.shape[1] - w + 1
            r = t[0][x[:, :span]]
            for k in range(1, w):
                r = r + t[k][x[:, k : k + span]]
            at = r.argmax(1)
            best.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            where.append(at)
        return np.maximum(np.concatenate(best, 1) + self.bias, 0), where

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.offset

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), BLOCK):
            best = []
            b = x[i : i + BLOCK]
            for w, t in self.tables.items():
                span = b.shape[1] - w + 1
                r = t[0][b[:, :span]]
                for k in range(1, w):
                    r += t[k][b[:, k : k + span]]
                best.append(r.max(1))
            out.append(_softmax(self.logits(np.maximum(np.concatenate(best, 1) + self.bias, 0))))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(data: bytes, length: int = LENGTH) -> np.ndarray:
    """All bytes in rows of ``length``, the last one padded with 0."""
    n = max(1, -(-len(data) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, length)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on cross entropy; x: (n, LENGTH) bytes, y: index of the language. Every class counts alike."""
    rng = np.random.default_rng(seed)
    net = Network(
        languages,
        {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    params = [*net.tables.values(), net.bias, net.weights, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    share = np.bincount(y, minlength=len(languages)).astype(np.float32)
    weight = (share.sum() / np.maximum(share, 1) / len(languages)).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            b, t = x[rows], y[rows]
            h, where = net.pooled(b)
            d = _softmax(net.logits(h))
            d[np.arange(len(t)), t] -= 1
            d *= (weight[t] / len(t))[:, None]
            dh = (d @ net.weights.T) * (h > 0)
            grads = []
            for j, (w, table) in enumerate(net.tables.items()):
                g, part = np.zeros_like(table), dh[:, j * FILTERS : (j + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), part.shape)
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(b, where[j] + k, 1), f), part)
                grads.append(g)
            grads += [dh.sum(0), h.T @ d, d.sum(0)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_of(labelled: DataFrame, max_windows: int = TRAIN_WINDOWS) -> list[tuple[str, str]]:
    """(lang, part of a text) of a bounded sample of rows (text, lang), up to three parts of each text.

    Every language counts; all together give ``max_windows`` parts at most, but each
    language at least one text. Texts are picked by the smallest hashes of the texts
    themselves, equal ones once, so repeated rows and repeated or null ids change nothing.
    """
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("first"))
    counts = counts.persist()
    n = counts.count()
    if not n:
        return []
    each = max(1, max_windows // 3 // n)
    # about twice as many as wanted pass by their hash, then exactly the smallest ones are taken
    share = F.pmod(F.xxhash64("h"), F.lit(1_000_003)) < F.lit(2.0 * each * 1_000_003) / F.col("n")
    likely = usable.join(counts, "lang").where(share | (F.col("h") == F.col("first"))).select("lang", "h", "text")
    likely = likely.groupBy("lang", "h").agg(F.min(F.struct(F.length("text").alias("size"), F.array(*[_part("text", "h", j) for j in range(3)]).alias("parts"))).alias("t"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))
    taken = likely.withColumn("nth", nth).where(F.col("nth") <= each)
    rows = sorted((r["lang"], r["part"]) for r in taken.select("lang", F.explode(F.array_distinct("t.parts")).alias("part")).collect())
    counts.unpersist()
    return rows


def _part(text: str, h: str, j: int) -> Column:
    at = F.pmod(F.xxhash64(h, F.lit(j)), F.greatest(F.length(text) - LENGTH + 1, F.lit(1))).cast("int") + 1
    return F.substring(text, at, F.lit(LENGTH + 3))


def learn(labelled: DataFrame, max_windows: int = TRAIN_WINDOWS) -> Network | None:
    """A network from rows (text, lang) and any other columns; None if there is nothing to learn from.

    It is trained on the bounded sample of ``sample_of``. A window may start within a
    character, as in scoring.
    """
    rows = sample_of(labelled, max_windows)
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    x = np.concatenate([windows_of(part.encode("utf-8", "surrogatepass")[k % 3 :][:LENGTH]) for k, (_, part) in enumerate(rows)])
    index = {lang: k for k, lang in enumerate(languages)}
    return train(x, np.array([index[lang] for lang, _ in rows]), languages)


def predict(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each input row.

    ``und`` with score 0 for null texts, texts without a letter and without a
    network. Texts of any length count whole. Of equally probable languages the first
    in code point order is taken. Repeated rows give a row each; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(network)  # its size is fixed by the module's constants
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text")
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            n = b.num_rows
            names: list[str] = ["und"] * n
            scores = [0.0] * n
            if net is not None:
                texts = b.column("text")
                todo: list[tuple[int, bytes]] = []
                size = 0
                for i in range(n):
                    value = texts[i].as_py()
                    if value is not None:
                        todo.append((i, value.encode("utf-8", "surrogatepass")))
                        size += len(todo[-1][1])
                    if todo and (size > 1 << 22 or i == n - 1):
                        for k, p in zip([t[0] for t in todo], _means(net, [t[1] for t in todo])):
                            names[k], scores[k] = net.languages[int(p.argmax())], float(min(1.0, p.max()))
                        todo, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {id_type}, lang_pred string, score double")


def _means(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text over its windows, weighted by the bytes in them."""
    parts = [windows_of(t) for t in texts]
    p = net.probabilities(np.concatenate(parts)).astype(np.float64)
    counts = np.array([len(x) for x in parts])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    weight = np.full(len(p), float(LENGTH))
    weight[starts + counts - 1] = [max(1, len(t) - (c - 1) * LENGTH) for t, c in zip(texts, counts)]
    total = np.add.reduceat(p * weight[:, None], starts, axis=0)
    return total / np.add.reduceat(weight, starts)[:, None]


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Query: the language of every document, learned from two thirds of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, learn(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
