"""Near-duplicate vectors: an exact metric range join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the vectors that link are those
within a radius. Vectors of one label are partitioned by their nearest pivot. A vector
also visits each cell whose own vectors may lie within the radius: by the triangle
inequality none does if the vector is farther from the cell's pivot than the cell's
reach plus the radius, or lies deeper than the radius behind the plane between that
pivot and its own. Cells then join independently, each in blocks of bounded size,
and a block returns counts and a spanning forest, never its pairs. Equal vectors
are joined once, as a class with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize

THRESHOLD = 0.93
#: Vectors of a cell on average; pivots in all (bounds what is broadcast); labels that can have pivots.
CELL, MAX_PIVOTS, MAX_LABELS = 4096, 4096, 1000
#: Own vectors and visitors of one block.
OWN, VISITORS = 1024, 2048
#: Rounding in distances that must not lose a pair.
SLACK = 1e-6


def _usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def link_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each input row.

    Vectors that are null, empty, zero or hold a null or non-finite component, rows
    without a label or an id link with nothing: n_links 0, their own component, kept.
    Vectors of different lengths don't link. Repeated rows count as other vectors.
    An empty table gives no rows; other columns are ignored.
    """
    all_rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    use = _usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    plus_zero = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one value
    marked = all_rows.withColumn("v", F.when(use, plus_zero)).withColumn("h", F.when(use, F.xxhash64("label", "v")))
    marked = materialize(marked, "range-rows")
    classes = materialize(
        marked.where("h is not null").groupBy("h", "label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "range-classes"
    )
    counts, edges = _join_cells(classes, threshold)
    component = connected_components(edges)
    told = (
        classes.join(counts, "id", "left")
        .join(component.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("h", F.col("label").alias("label"), "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    same = (F.col("r.h") == F.col("c.h")) & (F.col("r.label") == F.col("c.label")) & (F.col("r.v") == F.col("c.v"))
    out = marked.alias("r").join(told.alias("c"), same, "left")
    component_id = F.coalesce("c.component_id", "r.vec_id")
    return out.select(
        F.col("r.vec_id").alias("vec_id"),
        F.coalesce("c.n_links", F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(component_id == F.col("r.vec_id"), F.lit(True)).alias("kept"),
    )


def _pivots(classes: DataFrame) -> dict:
    """label -> (p, d) unit pivots, for labels with more than one cell; at most MAX_PIVOTS in all."""
    sizes = classes.groupBy("label", F.size("v").alias("dim")).count().orderBy(F.desc("count"), "label", "dim").limit(MAX_LABELS).collect()
    total = sum(r["count"] for r in sizes)
    wanted = {(r["label"], r["dim"]): min(r["count"] // CELL, MAX_PIVOTS * r["count"] // max(1, 2 * total)) / r["count"] for r in sizes}
    wanted = {k: p for k, p in wanted.items() if p > 0}
    if not wanted:
        return {}
    odds = F.create_map(*[x for (label, dim), p in wanted.items() for x in (F.struct(F.lit(label).alias("label"), F.lit(dim).alias("dim")), F.lit(p))])
    chance = odds[F.struct("label", F.size("v").alias("dim"))]
    picked = classes.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1_000_003)) < chance * 1_000_003)
    found: dict = {}
    for r in picked.orderBy(F.xxhash64("id", F.lit("pivot"))).limit(MAX_PIVOTS).collect():
        found.setdefault((r["label"], len(r["v"])), []).append(r["v"])
    return {k: _unit(np.array(v)) for k, v in found.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))


_CELL = "cell string, own boolean, id {id}, copies long, v binary"


def _join_cells(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) and edges (a, b) between classes."""
    spark = classes.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    pivots = spark.sparkContext.broadcast(_pivots(classes))
    id_type = classes.schema["id"].dataType.simpleString()

    def units(b: pa.RecordBatch):
        """Rows of a batch by label and length: (label, dim), positions, unit vectors."""
        labels, vectors = b.column("label").to_pylist(), b.column("v").to_pylist()
        groups: dict = {}
        for i, (label, v) in enumerate(zip(labels, vectors)):
            groups.setdefault((label, len(v)), []).append(i)
        for key, at in groups.items():
            yield key, at, _unit(np.array([vectors[i] for i in at]))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each cell's largest distance between its pivot and an own vector, of this task's rows."""
        most: dict = {}
        for b in batches:
            for key, _, x in units(b):
                if (p := pivots.value.get(key)) is not None:
                    d = _distances(x, p)
                    home = d.argmin(1)
                    for j in np.unique(home):
                        cell = f"{key[0]}/{key[1]}/{j}"
                        most[cell] = max(most.get(cell, 0.0), float(d[home == j, j].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.string()), pa.array(list(most.values()), pa.float64())], ["cell", "reach"])

    reaches = spark.sparkContext.broadcast(
        {r["cell"]: r["reach"] for r in classes.mapInArrow(reach, "cell string, reach double").groupBy("cell").agg(F.max("reach").alias("reach")).collect()}
        if pivots.value
        else {}
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies = b.column("id").to_pylist(), b.column("copies").to_pylist()
            for key, at, x in units(b):
                p = pivots.value.get(key)
                name = f"{key[0]}/{key[1]}"
                if p is None:
                    where = [(name, True, k) for k in range(len(at))]
                else:
                    d = _distances(x, p)
                    home = d.argmin(1)
                    far = np.array([reaches.value.get(f"{name}/{j}", -9.0) for j in range(len(p))])
                    between = _distances(p, p)
                    behind = d**2 - (d[np.arange(len(x)), home] ** 2)[:, None]
                    visit = (d <= far + radius) & (behind <= 2 * between[home] * radius + SLACK)
                    visit[np.arange(len(x)), home] = False
                    where = [(f"{name}/{j}", True, k) for k, j in enumerate(home)]
                    where += [(f"{name}/{j}", False, k) for k, j in zip(*np.nonzero(visit))]
                cols = [
                    pa.array([w[0] for w in where], pa.string()),
                    pa.array([w[1] for w in where], pa.bool_()),
                    pa.array([ids[at[w[2]]] for w in where], b.schema.field("id").type),
                    pa.array([copies[at[w[2]]] for w in where], pa.int64()),
                    pa.array([x[w[2]].tobytes() for w in where], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "own", "id", "copies", "v"])

    placed = materialize(classes.mapInArrow(place, _CELL.format(id=id_type)), "range-placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if("own") / OWN).alias("owns"), F.ceil(F.count(F.lit(1)) / VISITORS).alias("visits"))
    # an own vector goes to one row of blocks, and every vector, as a visitor, to one column of them
    sized = placed.join(materialize(sizes, "range-sizes"), "cell")
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    one = sized.where("own").select("cell", block("owns").alias("i"), every("visits").alias("j"), F.lit(True).alias("own"), "id", "copies", "v")
    two = sized.select("cell", every("owns").alias("i"), block("visits").alias("j"), F.lit(False).alias("own"), "id", "copies", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = pdf[pdf["own"]], pdf[~pdf["own"]]
        if not len(own) or not len(other):
            return pd.DataFrame({"id": [], "links": [], "root": []})
        a, b = (np.frombuffer(b"".join(x["v"]), np.float64).reshape(len(x), -1) for x in (own, other))
        ia, ib = own["id"].to_numpy(), other["id"].to_numpy()
        linked = (b @ a.T >= threshold) & (ib[:, None] != ia[None, :])
        links = linked @ own["copies"].to_numpy()
        # components of this block: the smallest id spreads over links until nothing changes
        root_a, root_b = ia.copy(), ib.copy()
        at_b, at_a = np.nonzero(linked)
        while len(at_b):
            before = root_a.copy(), root_b.copy()
            np.minimum.at(root_b, at_b, root_a[at_a])
            np.minimum.at(root_a, at_a, root_b[at_b])
            if (before[0] == root_a).all() and (before[1] == root_b).all():
                break
        any_a = linked.any(0)
        any_b = links > 0
        return pd.DataFrame(
            {
                "id": np.concatenate([ib[any_b], ia[any_a]]),
                "links": np.concatenate([links[any_b], np.zeros(any_a.sum(), np.int64)]),
                "root": np.concatenate([root_b[any_b], root_a[any_a]]),
            }
        )

    found = one.unionByName(two).groupBy("cell", "i", "j").applyInPandas(compare, f"id {id_type}, links long, root {id_type}")
    found = materialize(found, "range-found")
    return found.groupBy("id").agg(F.sum("links").alias("links")), found.select(F.col("id").alias("a"), F.col("root").alias("b"))


def op8_vectors(spark, sf_dir: str) -> DataFrame:
    """Query: links and component of every embedding, among equal labels, at cosine 0.93."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
