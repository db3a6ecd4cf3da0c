"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Sets of similar size form bands;
within a band, sets with enough similarity differ in at most H elements. The domain
of shingles is partitioned by hash into ``n1`` parts of ``n2`` = 2 subparts each; each
way to choose ``n2 - k2`` = 1 subpart of a part is a signature: a digest of the set's
elements there. Two sets that differ in at most H elements agree on at least
``2 * n1 - H`` signatures. A set also signs for every larger band in which a similar set
can lie. ``n1`` is half again as large as needed, so of a similar pair more than W
signatures agree; a set may leave out its first W in one order for all: those of one
element or none, which say little, then the most common ones.

Equal sets are one class from the start. Signatures are shuffled packed, as arrays for
each bucket of their hash space. In a bucket, sets that share a signature give candidate
pairs: all pairs of a small group. Candidates whose parity sketches (a lower bound on how
many elements differ) leave room are verified on their sets.

A large group is split instead, and never paired with itself. One member, the set that
lies in most groups, is its hub, and each member is compared with it. Members close to the
hub are then described by their differences D from it: what two similar sets differ in is
what their D differ in, so D of a pair that isn't linked through the hub must overlap, and
shares one of its rarest elements (prefixes in one order, lengths from the overlap needed).
Members far from the hub share one of the rarest elements of the sets themselves. Both
zones overlap by the Jaccard distance that a link may span, so by the triangle inequality
each link lies whole in one. Sets that share no rare element with any other go first. Groups
that share such an element are split anew, with a hub of their own, until what is left can
be paired at a bounded cost for each set; a pair needs two components, fitting sizes and
enough elements left to overlap. Groups within one component are done.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .id_filter import id_filter, may_be_in, may_hold
from .store import materialize, materialize_by

#: Sizes of a band: the largest is so many times the smallest.
BAND = 1.3
#: Subparts of a part, and how many of them may differ (the bound on agreements is that of 2 and 1).
N2, K2 = 2, 1
#: How many times the parts that are needed, for signatures to leave out.
SPARE_PARTS = 1.5
#: A group of sets that share a signature gives all its pairs up to this size.
SMALL_GROUP = 6
#: Large groups are split until pairing their members takes so many comparisons (of bounds, not of sets) for
#: each distinct set of the corpus at most, or so often; then members are paired under the same bounds.
PAIR_WORK, MAX_SPLITS = 500, 6
#: Similarity in percent from which a member counts as close to its hub.
CLOSE = 50
#: A level is a band's number and, in so many bits, how many signatures may be left out (sets of 10^8 elements fit).
LEVEL_BITS = 25
#: Text bytes for each bucket of signatures, and words of the cache of one worker.
BUCKET_BYTES, CACHE_WORDS = 16 << 20, 300_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash by word (bytes), bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 17)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = WordHashes()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; with fewer words, of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 23)], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out * _M1 + h[j : j + n])
    return np.unique(out)


@dataclass(frozen=True)
class Band:
    """Sizes low..high; ``parts`` first-level parts; more than ``weak`` signatures of a similar pair agree."""

    low: int
    high: int
    parts: int
    weak: int


def bands(percent: int, largest: int) -> list[Band]:
    """The bands of all sizes whose sets can link to a different set."""
    out = []
    # the smallest size a with 100 * a >= percent * (a + 1): a set of one more element can hold it
    low = max(1, -(-percent // (100 - percent))) if percent < 100 else largest + 1
    while low <= largest:
        high = max(low, int(low * BAND))
        differ = (100 - percent) * 2 * high // (100 + percent)
        parts = math.ceil((differ + 1) * SPARE_PARTS / (K2 + 1))
        out.append(Band(low, high, parts, parts * (K2 + 1) - differ - 1))
        low = high + 1
    return out


def signing(size: int, lows: list[int], percent: int) -> range:
    """Numbers of the bands that a set of this size signs for: its own, and larger ones that a similar set may lie in."""
    return range(bisect.bisect_right(lows, size) - 1, bisect.bisect_right(lows, size * 100 // percent)) if lows and size >= lows[0] else range(0)


def signatures(x: np.ndarray, band: Band, number: int) -> tuple[np.ndarray, int]:
    """The set's signatures in a band without weak ones (one element or none), and how many more may be left out."""
    cells = band.parts * N2
    at = ((x >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)  # part at // N2, subpart at % N2
    sums = np.zeros(cells, np.uint64)
    np.add.at(sums, at, mix(x ^ _M1))
    sizes = np.bincount(at, minlength=cells)
    with np.errstate(over="ignore"):
        place = np.arange(cells, dtype=np.uint64) + np.uint64(number << 32)
        sig = mix(mix(sums) ^ mix(place))
    # at most band.weak go, first those of no element, then of one: the same order for every set
    order = np.argsort(sizes, kind="stable")
    gone = min(band.weak, int((sizes <= 1).sum()))
    return sig[np.sort(order[gone:])], band.weak - gone


def sketch(x: np.ndarray) -> bytes:
    """Parities of the numbers of elements in parts of the hash space, between two and four parts for each element."""
    bits = 1 << max(3, math.ceil(math.log2(max(1, 2 * len(x)))))
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(size_a: int, size_b: int, a: bytes, b: bytes, percent: int) -> bool:
    """Whether the sketches leave room for enough similarity: a bound, so no similar pair fails."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))  # the larger one folds: its parts of equal lower bits belong together
    differ = int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))).sum())
    return (100 + percent) * max(differ, abs(size_a - size_b)) <= (100 - percent) * (size_a + size_b)


def set_id(x: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes())


def packed_signatures(texts: pa.Array, k: int, percent: int, levels: list[Band], buckets: int) -> pa.RecordBatch | None:
    """For each bucket the signatures of the texts' sets, with the set and level of each.

    Every signature carries its own, so its bytes don't depend on how many buckets there are.
    """
    lows = [b.low for b in levels]
    sigs, of, ids, marks, seen = [], [], [], [], set()
    for t in texts:
        x = shingle_set(t.as_py(), k)
        if not (numbers := signing(len(x), lows, percent)) or (i := set_id(x)) in seen:
            continue
        seen.add(i)
        for number in numbers:
            s, more = signatures(x, levels[number], number)
            sigs.append(s)
            of.append(np.full(len(s), len(ids), np.int64))
            ids.append(i)
            marks.append(number << LEVEL_BITS | more)
    if not sigs:
        return None
    sig, own, ids, marks = np.concatenate(sigs), np.concatenate(of), np.array(ids, np.uint64), np.array(marks, np.uint32)
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sig, own, bucket = sig[order], own[order], bucket[order]
    ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    columns = [pa.array([c[a:e].tobytes() for a, e in zip(starts, ends)], pa.binary()) for c in (sig, ids[own], marks[own])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *columns], ["bucket", "sigs", "sets", "levels"])


def link_documents(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each input row.

    Null and blank texts have no shingles, link with nothing and are their own
    component. Rows with equal sets link; rows that share an id are linked through it
    only if their sets link. A null id takes part in no component. Texts of any length count whole;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = lambda values: pa.array(np.asarray(values, np.uint64).view(np.int64))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, sketches = [], [], []
            for t in b.column("text"):
                x = shingle_set(t.as_py(), k)
                n.append(len(x))
                ids.append(set_id(x))
                sketches.append(sketch(x))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), signed(ids), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set", "sketch"]
            )

    told = materialize(rows.mapInArrow(described, f"doc_id {id_type}, n_shingles long, set long, sketch binary"), "jaccard-sets")
    classes = told.where("n_shingles > 0 and doc_id is not null").groupBy("set", "n_shingles").agg(F.min("doc_id").alias("first"), F.min("sketch").alias("sketch"))
    classes = materialize(classes, "jaccard-classes")
    size = told.agg(F.max("n_shingles").alias("most")).first()["most"] or 0
    volume = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    edges = _links(rows, classes, k, percent, bands(percent, int(size)), max(16, volume // BUCKET_BYTES))

    component = connected_components(edges)
    first = classes.join(component.withColumnRenamed("node", "set"), "set", "left").select("set", "first", F.coalesce("component", "set").alias("root"))
    first = materialize(first, "jaccard-roots")
    smallest = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(first.join(smallest, "root").select("set", "component_id"), "jaccard-named")
    has = (F.col("t.n_shingles") > 0) & F.col("t.doc_id").isNotNull() & (F.col("t.set") == F.col("c.set"))
    out = told.alias("t").join(named.alias("c"), has, "left")
    return out.select("t.doc_id", "t.n_shingles", F.coalesce("c.component_id", "t.doc_id").alias("component_id"))


def _links(rows: DataFrame, classes: DataFrame, k: int, percent: int, levels: list[Band], buckets: int) -> DataFrame:
    """Edges (a, b) between set ids: enough of the similar pairs for the right components."""
    if not levels:
        return classes.select(F.col("set").alias("a"), F.col("set").alias("b")).limit(0)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2500):
                if (b := packed_signatures(whole.column("text").slice(start, 2500), k, percent, levels, buckets)) is not None:
                    yield b

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        """Candidate pairs of a bucket (sig null), and the members of its large groups (b null)."""
        sig, own, level = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("sigs", np.uint64), ("sets", np.uint64), ("levels", np.uint32)))
        order = np.lexsort((own, sig))
        sig, own, level = sig[order], own[order], level[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own, level = sig[new], own[new], level[new].astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(heads, len(sig)))
        a, b = [], []
        for m in range(2, SMALL_GROUP + 1):
            h = heads[sizes == m]
            for i, j in itertools.combinations(range(m), 2):
                a.append(own[h + i])
                b.append(own[h + j])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.uint64)
        many = np.repeat(sizes, sizes)
        at = np.flatnonzero(many > SMALL_GROUP)
        pairs, group, member = pairs.astype(np.uint64).view(np.int64), sig[at].view(np.int64), own[at].view(np.int64)
        none = lambda n: pd.Series(pd.array([pd.NA] * n, "Int64"))
        column = lambda x: pd.Series(pd.array(x, "Int64"))
        both = lambda x, y: pd.concat([x, y], ignore_index=True)
        p, m = none(len(pairs)), none(len(at))
        return pd.DataFrame({"sig": both(p, column(group)), "a": both(column(pairs[:, 0]), column(member)), "b": both(column(pairs[:, 1]), m), "size": both(p, column(many[at])), "level": both(p, column(level[at]))})

    found = rows.select("text").where("text is not null").mapInArrow(packed, "bucket long, sigs binary, sets binary, levels binary")
    found = materialize(found.groupBy("bucket").applyInPandas(shared, "sig long, a long, b long, size long, level long"), "jaccard-found")
    likely = materialize(_possible(found.where("sig is null").select("a", "b").distinct(), classes, percent), "jaccard-likely")
    # Of a similar pair more than W signatures agree in a band. Both may leave out their most
    # common ones, W less the weak ones: of the agreeing ones these are the same first few.
    common = Window.partitionBy("a", "level").orderBy(F.desc("size"), "sig")
    groups = found.where("b is null").withColumn("nth", F.row_number().over(common)).where(F.col("nth") > F.col("level") % (1 << LEVEL_BITS)).select(F.col("sig").alias("g"), F.col("a").alias("set"))
    groups = materialize(groups, "jaccard-groups")

    wanted = likely.select(F.explode(F.array("a", "b")).alias("set")).unionByName(groups.select("set")).distinct()
    elements = materialize_by(_elements(wanted, rows, classes, k), "jaccard-elements", "set")
    links = materialize(_verified(likely, elements, percent), "jaccard-links")
    if groups.isEmpty():
        return links
    ranked = materialize_by(_ranked(groups.select("set").distinct().join(elements, "set")), "jaccard-ranked", "set")
    # a set that shares none of its rarest elements with another one of a large group links with none of them
    size = F.size("e")
    shares = F.element_at("n", (size - F.ceil(F.lit(percent) * size / 100) + 1).cast("int")) > 1
    groups = materialize(groups.join(ranked.where(shares).select("set"), "set"), "jaccard-groups")
    placed = lambda df: df.join(component, "set", "left").withColumn("c", F.coalesce("c", "set"))
    component = _components(links)
    enough = PAIR_WORK * classes.count()
    for _ in range(MAX_SPLITS):
        # groups of several components, and their hubs: the member of most groups
        weighed = placed(groups).withColumn("w", F.count(F.lit(1)).over(Window.partitionBy("set")))
        hubs = weighed.groupBy("g").agg(F.max_by("set", F.struct("w", "set")).alias("hub"), F.min("c").alias("low"), F.max("c").alias("high"))
        hubs = materialize(hubs.where("low <> high").select("g", "hub"), "jaccard-hubs")
        if hubs.isEmpty():
            return links
        compared = materialize(_compared(groups.join(hubs, "g").where("set <> hub").select("hub", "set").distinct(), hubs, ranked, percent), "jaccard-compared")
        near = compared.where("role = 0").select(F.col("set").alias("a"), F.col("g").alias("b"))
        links = materialize(links.unionByName(near), "jaccard-links")
        component = _components(links)
        rest = placed(compared.where(F.col("role").between(1, 7)).unionByName(_rare_elements(compared.where("role = 8").select("set").distinct().join(ranked, "set"), percent)))
        mixed = lambda df, *more: df.groupBy("g").agg(F.count(F.lit(1)).alias("many"), F.min("c").alias("low"), F.max("c").alias("high"), *more).where("low <> high").drop("low", "high")
        # a member that overlaps too little even with the nearest possible partner goes
        reach = mixed(rest, F.min("need").alias("least"), F.max("rest").alias("most")).drop("many")
        able = F.col("need") + F.col("least") <= 2 * (100 + percent) * F.least("rest", "most")
        rest = materialize(rest.join(reach, "g").where(able).drop("least", "most"), "jaccard-able")
        sizes = materialize(mixed(rest), "jaccard-sizes")
        rest = rest.join(sizes, "g")
        if (sizes.agg(F.sum(F.col("many") * F.col("many") / 2).alias("work")).first()["work"] or 0) <= enough:
            break
        groups = rest.select("g", "set")
    side = lambda name: rest.select("g", F.struct("set", "role", "need", "rest", "size", "c").alias(name))
    pairs = side("x").join(side("y"), "g").where(_may_meet(F.col("x"), F.col("y"), percent)).select(F.col("x.set").alias("a"), F.col("y.set").alias("b"))
    pairs = materialize(pairs.distinct(), "jaccard-pairs")
    if pairs.isEmpty():
        return links
    pairs = materialize(_possible(pairs, classes, percent), "jaccard-pairs")
    # only lists that are left are dealt by set, in a table of their own: joins may split what many pairs have in common
    own = materialize(elements.join(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set"), "jaccard-own")
    return links.unionByName(_verified(pairs, own, percent))


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("set"), F.col("component").alias("c"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column, unsigned."""
    values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _elements(wanted: DataFrame, rows: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """set, e: the elements of each wanted set, once, from a text that has them.

    No text is shuffled: where it is read, a filter of the wanted ids tells which ones can't have a wanted set.
    """
    wanted = materialize(wanted.join(classes, "set").select("set", "first"), "jaccard-wanted")
    ids = id_filter(wanted, "first")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column("text").filter(pa.array(may_hold(ids.value, whole.column("h").to_numpy())))
            for start in range(0, len(texts), 500):
                sets = [shingle_set(t.as_py(), k) for t in texts.slice(start, 500)]
                own = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([set_id(x) for x in sets], np.uint64).view(np.int64)), own], ["set", "e"])

    found = rows.where("text is not null and doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(told, "set long, e array<long>")
    # an id that several rows share, or the filter, may bring other sets than the wanted ones
    return found.join(wanted.select("set"), "set", "left_semi").groupBy("set").agg(F.first("e").alias("e"))


def _ranked(elements: DataFrame) -> DataFrame:
    """set, e, n: elements by how many of the sets hold them (n), then by value."""
    each = elements.select("set", F.explode("e").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = each.join(often, "x").groupBy("set").agg(F.collect_list("x").alias("x"), F.collect_list("n").alias("n"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, n = [], []
            for x, shared, count in zip(*(_lists(b.column(c)) for c in ("e", "x", "n"))):
                times = np.ones(len(x), np.int64)
                times[np.searchsorted(x, shared)] = count.view(np.int64)
                order = np.lexsort((x, times))
                e.append(x[order].view(np.int64))
                n.append(times[order])
            lists = [pa.array(v, pa.list_(pa.int64())) for v in (e, n)]
            yield pa.RecordBatch.from_arrays([b.column("set"), *lists], ["set", "e", "n"])

    empty = F.array().cast("array<long>")
    joined = elements.join(known, "set", "left").select("set", "e", F.coalesce("x", empty).alias("x"), F.coalesce("n", empty).alias("n"))
    return joined.mapInArrow(ordered, "set long, e array<long>, n array<long>")


def prefixes(x: np.ndarray, n_x: np.ndarray, h: np.ndarray, n_h: np.ndarray, percent: int) -> tuple[bool, bool, tuple | None]:
    """Whether x links with its hub h, whether it is far, and if close by which differences it may meet other members.

    Those are arrays (element, role, need, rest): roles 1 and 2 are those of a set not linked
    with the hub, towards others of that kind and towards linked ones; 4 is a linked set's.
    Two members can be similar only if need + need <= 2 * (100 + percent) * min(rest, rest) at
    their first common element.
    """
    q, r = 100 + percent, 100 - percent
    in_h, in_x = np.isin(x, h, assume_unique=True), np.isin(h, x, assume_unique=True)
    common = int(in_h.sum())
    union = len(x) + len(h) - common
    linked = 100 * common >= percent * union
    out = None
    if 100 * common >= CLOSE * union:
        # inserted elements come first, rare ones before; then the hub's own, those that few lack before
        d = np.concatenate([x[~in_h], h[~in_x]])
        times = np.concatenate([n_x[~in_h], (1 << 62) - n_h[~in_x]])
        order = np.lexsort((d, times))
        d, useful = d[order], times[order] > 1
        need = q * len(d) - r * len(x)
        if need > r * len(h):
            least = -(-(need + r * len(h) + 1) // (2 * q)), -(-(need - r * (100 * len(x) // percent)) // q)
            lengths = [len(d) - max(1, o) + 1 for o in least]
            roles = (np.arange(len(d)) < lengths[0]) * 1 + (np.arange(len(d)) < lengths[1]) * 2
        else:
            roles = (np.arange(len(d)) < len(d) - max(1, -(-(need + r * len(h) + 1) // (2 * q))) + 1) * 4
        at = np.flatnonzero((roles > 0) & useful)
        out = d[at], roles[at], need, len(d) - at
    return linked, 100 * common < (CLOSE + r) * union, out


def _rare_elements(ranked: DataFrame, percent: int) -> DataFrame:
    """Rows (g, role 8) of each set's rarest elements: one of them is in every set similar to it that others hold too."""
    size = F.size("e")
    first = (size - F.ceil(F.lit(percent) * size / 100) + 1).cast("int")
    at = F.transform(F.arrays_zip(F.slice("e", F.lit(1), first).alias("e"), F.slice("n", F.lit(1), first).alias("n")), lambda p, i: F.struct(p["e"].alias("e"), p["n"].alias("n"), i.alias("i")))
    rows = ranked.select("set", size.cast("long").alias("size"), F.explode(F.filter(at, lambda p: p["n"] > 1)).alias("p"))
    need = (2 * percent * F.col("size")).alias("need")
    return rows.select(F.xxhash64("p.e").alias("g"), "set", F.lit(8).cast("long").alias("role"), need, (F.col("size") - F.col("p.i")).alias("rest"), "size")


def _compared(pairs: DataFrame, hubs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Members compared with their hubs: (g = hub, role 0) for links, (role 8) for far ones, and rows of the groups g in which close ones may meet others."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[], [], [], [], [], []]

            def add(g, own, role, need, rest, size):
                for column, v in zip(found, (g, own, role, need, rest, size)):
                    column.append(np.broadcast_to(np.asarray(v, np.int64), len(g)))

            lists = [_lists(b.column(c)) for c in ("e", "n", "e_hub", "n_hub")]
            for own, hub, x, n_x, h, n_h in zip(b.column("set").to_pylist(), b.column("hub").to_pylist(), *lists):
                linked, far, meets = prefixes(x, n_x.view(np.int64), h, n_h.view(np.int64), percent)
                for role in [0] * linked + [8] * far:
                    add(np.array([hub]), own, role, 0, 0, len(x))
                if meets is not None:
                    e, roles, need, rest = meets
                    with np.errstate(over="ignore"):
                        place = mix(np.array([hub], np.int64).view(np.uint64) * _M1)
                        add(mix(e ^ place).view(np.int64), own, roles, need, rest, len(x))
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["g", "set", "role", "need", "rest", "size"])

    # the hubs' lists are a table of their own: its join may split what many members have in common
    hub = ranked.select(F.col("set").alias("hub"), F.col("e").alias("e_hub"), F.col("n").alias("n_hub"))
    hub = materialize(hub.join(hubs.select("hub").distinct(), "hub"), "jaccard-hub-lists")
    joined = pairs.join(ranked, "set").join(hub, "hub")
    return joined.mapInArrow(compared, "g long, set long, role long, need long, rest long, size long")


def _may_meet(x: Column, y: Column, percent: int) -> Column:
    """Whether two members (structs) of a group of ``_compared`` may be similar: once, for the smaller set id."""
    role = lambda i, j: (x.role.bitwiseAND(i) > 0) & (y.role.bitwiseAND(j) > 0)
    meets = role(1, 1) | role(2, 4) | role(4, 2) | role(8, 8)
    enough = x.need + y.need <= 2 * (100 + percent) * F.least(x.rest, y.rest)
    return (y.set > x.set) & (y.c != x.c) & meets & enough & (100 * F.least(x.size, y.size) >= percent * F.greatest(x.size, y.size))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches don't rule out."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")))
            yield b.select(["a", "b"]).filter(pa.array([may_link(*r, percent) for r in rows], pa.bool_()))

    side = lambda c: classes.select(F.col("set").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return joined.mapInArrow(bounded, "a long, b long")


def _verified(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough: 100 * intersection >= percent * union."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(_lists(b.column("e_a")), _lists(b.column("e_b"))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: elements.select(F.col("set").alias(name), F.col("e").alias(f"e_{name}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "e_a", "e_b").mapInArrow(similar, "a long, b long")


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the one with the smallest id.

    Rows with a null id stay. Rows that share an id: of equal ones one stays.
    """
    linked = materialize(link_documents(docs, k, percent, doc_id, text), "jaccard-kept")
    heads = F.count_if(F.col("doc_id") == F.col("component_id")).alias("__n")
    ids = materialize(linked.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(heads), "jaccard-heads")
    changed = materialize(ids.where("__n <> 1"), "jaccard-changed")  # ids that go, and those that rows share
    # rows that can't have such an id stay where they are; only the others' texts are shuffled
    possible = may_be_in(doc_id, id_filter(changed, "__id"))
    rest, same = docs.where(possible), F.col(doc_id) == F.col("__id")
    kept = docs.where(~possible).unionByName(rest.join(changed.select("__id"), same, "left_anti"))
    shared = changed.where("__n > 1").select("__id")
    return kept if shared.isEmpty() else kept.unionByName(rest.join(shared, same, "left_semi").dropDuplicates([doc_id, text]))


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    """Query: shingles and component of every document, four words, similarity 0.85."""
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
