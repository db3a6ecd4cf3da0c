"""Mixing sources to target weights by entropy balancing.

Every source gets a token target. Of all rates between 0 and a maximum that meet it,
entropy balancing takes those closest (in Kullback-Leibler divergence, every document
having base measure one) to the corpus as it is: minimise the sum of
``r * log(r) - r`` over documents so that the sum of ``r * size`` is the target. The
convex dual has one multiplier for each source, and its primal solution is the
exponential tilt ``r = min(max_rate, exp(multiplier * size / mean size))``, so rates
differ by document. Newton's method finds the multipliers: in every step gradient and
Hessian are sums over the documents, pre-aggregated by source and size, which differ
in nothing that counts here; a bracket that each step narrows keeps it convergent.
Rates are rounded into whole copies by systematic sampling along the document sizes,
within groups of bounded size, and the rest is mended with the smallest documents, so
that taken words stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .words import n_words_of, trimmed

#: Documents of one rounding group; hot sources are dealt over many groups.
GROUP_DOCS = 4096
#: Newton stops when every constraint holds to this relative error.
TOLERANCE = 1e-9


def source_targets(sizes: DataFrame, weights=(5, 2, 1), budget: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """One row for each source: source, source_size, n_docs, weight, target.

    Sources in code point order, null last, get the weights in turn. The budget
    (a share of all words) is split by weight; a source stops at ``max_rate``
    times its size, and what exceeds that is split again by weight among the
    others. A budget above ``max_rate`` ends with every source at its stop.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = _ranked(materialize(totals, "mix-sources"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(
        ranked.withColumn("weight", cycle[((F.col("rank") - 1) % len(weights)).cast("int")]).withColumn(
            "cap", F.col("source_size") * F.lit(float(max_rate))
        ),
        "mix-weights",
    )
    goal = float(budget) * float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"])
    level, stopped = None, -1
    while True:  # each round stops at least one more source
        above = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        now = ranked.agg(
            F.count_if(above).alias("stopped"),
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if now["stopped"] == stopped or now["weight"] == 0:
            level = level if now["weight"] else float("inf")
            break
        stopped, level = now["stopped"], max(0.0, goal - now["held"]) / now["weight"]
    share = F.col("cap") if level == float("inf") else F.least("cap", F.lit(level or 0.0) * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", "weight", share.alias("target"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 1, in code point order with null last, without one task for all:
    rows are dealt by range, numbered within each range, and moved by the ranges' counts."""
    key = [F.col("source").isNull().asc(), F.col("source").asc()]
    dealt = materialize(
        sources.repartitionByRange(8, *key).withColumn("part", F.spark_partition_id()),
        "mix-ranges",
    )
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # at most 8 rows
    before = parts.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    return dealt.withColumn("local", local).join(before, "part").withColumn("rank", F.col("local") + F.col("before")).drop("part", "local", "before")


def balance(sizes: DataFrame, targets: DataFrame, max_rate: float = 2.0, tolerance: float = TOLERANCE, max_steps: int = 100) -> DataFrame:
    """``targets`` with multiplier: the dual solution of each source's token constraint.

    The rate of a document is ``tilt(multiplier, size, mean, max_rate)``. A source without
    words or with target 0 has a null multiplier, and rate 0. A source whose target is
    ``max_rate`` times its size has the multiplier from which all its rates are ``max_rate``.
    """
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    ratio = F.log(F.try_divide("target", "source_size"))  # null for a source without words
    # where the smallest size possible, one word, is tilted far enough, all are
    state = targets.withColumn("mean", F.col("source_size") / F.col("n_docs")).withColumn("least", F.least(F.lit(0.0), ratio * F.col("mean")))
    state = state.withColumn("most", F.when(ratio > 0, F.log(F.lit(float(max_rate))) * F.col("mean")).otherwise(0.0))
    full = F.col("target") >= F.col("source_size") * F.lit(float(max_rate)) * (1 - tolerance)
    state = state.withColumn("multiplier", F.when(live, F.when(full, F.col("most")).otherwise(ratio))).withColumn("done", F.coalesce(~live | full, F.lit(True)))
    state = materialize(state, "mix-newton")
    alike = materialize(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-alike")
    for _ in range(max_steps):
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        each = alike.alias("a").join(open_.alias("o"), F.col("a.source").eqNullSafe(F.col("o.source"))).select("o.source", "size", "n", "mean", "multiplier")
        rate = tilt(F.col("multiplier"), F.col("size"), F.col("mean"), max_rate)
        words = F.col("n") * F.col("size") * rate
        sums = each.groupBy("source").agg(F.sum(words).alias("words"), F.sum(F.when(rate < max_rate, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("hessian"))
        now = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "words", "hessian")
        gradient = F.col("words") - F.col("target")
        now = now.withColumn("least", F.when(gradient < 0, F.col("multiplier")).otherwise(F.col("least"))).withColumn("most", F.when(gradient > 0, F.col("multiplier")).otherwise(F.col("most")))
        newton = F.col("multiplier") - F.try_divide(gradient, F.col("hessian"))
        inside = (F.col("hessian") > 0) & (newton > F.col("least")) & (newton < F.col("most"))
        met = F.col("done") | (F.abs(gradient) <= tolerance * F.col("target")) | (F.col("most") - F.col("least") <= 1e-15 * F.col("mean"))
        moved = F.when(met, F.col("multiplier")).when(inside, newton).otherwise((F.col("least") + F.col("most")) / 2)
        state = materialize(now.withColumn("multiplier", moved).withColumn("done", met).drop("words", "hessian"), "mix-newton")
    return state.drop("least", "most", "done")


def tilt(multiplier: Column, size: Column, mean: Column, max_rate: float) -> Column:
    """The rate of a document; 0 where the multiplier is null."""
    return F.coalesce(F.least(F.lit(float(max_rate)), F.exp(F.try_divide(multiplier * size, mean))), F.lit(0.0))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=(5, 2, 1),
    budget: float = 1.5,
    max_rate: int = 2,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """Plan a mix: doc_id, size, source_size, target, rate, copies, taken for each input row.

    A null or blank text has size 0 and is taken 0 times; texts of any length count whole. A null source is a source
    of its own, the last. Repeated rows are rounded as separate documents; ties in
    size go by id, and rows equal in both are interchangeable. An empty table gives
    an empty plan. Other columns of ``docs`` are ignored, whatever their names.
    """
    sizes = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words_of(trimmed(F.col(text))).alias("size")), "mix-sizes"
    )
    rates = materialize(balance(sizes, source_targets(sizes, weights, budget, max_rate), max_rate), "mix-rates")
    rate = tilt(F.col("multiplier"), F.col("size"), F.col("mean"), max_rate)
    groups = F.ceil(F.col("n_docs") / F.lit(group_docs))
    dealt = (
        sizes.alias("d")
        .join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
        .select("d.doc_id", "d.source", "size", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64("d.doc_id", "size"), groups).alias("group"))
    )
    whole = F.floor(F.col("rate") + F.lit(1e-9))
    part = F.greatest(F.lit(0.0), F.col("rate") - whole)
    along = Window.partitionBy("source", "group").orderBy(F.desc("size"), F.asc("doc_id"))
    upto = F.sum(part).over(along.rowsBetween(Window.unboundedPreceding, 0))
    # a rate near 1 or 0 adds next to nothing, and rounding to 9 digits takes equal sums for equal
    dealt = dealt.withColumn("n", F.row_number().over(along)).withColumn("upto", F.round(upto, 9)).withColumn("before", F.coalesce(F.lag("upto").over(along), F.lit(0.0)))
    picked = materialize(
        dealt.withColumn("extra", (F.floor(F.col("upto") + 0.5) - F.floor(F.col("before") + 0.5)).cast("int")).drop("upto", "before").withColumn(
            "copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(whole.cast("int") + F.col("extra"))
        ),
        "mix-picked",
    )
    return _mended(picked, max_rate).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _mended(picked: DataFrame, max_rate: int) -> DataFrame:
    """Moves each source's taken words to its target: first the one document that closes
    the gap best, then the smallest documents of the source's first group."""
    up = (F.col("short") > 0) & (F.col("copies") < max_rate)
    down = (F.col("short") < 0) & (F.col("copies") > 0)
    usable = (F.col("size") > 0) & (up | down)
    step = F.signum("short").cast("int")

    rows = _with_error(picked)
    left = F.abs(F.abs("short") - F.col("size"))
    best = rows.where(usable & (left < F.abs("short"))).groupBy("source").agg(F.min_by(F.struct("group", "n"), F.struct(left, "group", "n")).alias("best"))
    best = materialize(best, "mix-best")
    hit = (F.col("group") == F.col("best.group")) & (F.col("n") == F.col("best.n"))
    rows = rows.alias("p").join(best.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")), "left").select("p.*", "best")
    rows = rows.withColumn("copies", F.col("copies") + F.when(hit, step).otherwise(0)).drop("best", "short")

    rows = _with_error(materialize(rows, "mix-once"))
    order = Window.partitionBy("source", "group", usable).orderBy("size", "n").rowsBetween(Window.unboundedPreceding, 0)
    moved = usable & (F.col("group") == 0) & (F.sum("size").over(order) <= F.abs("short") + F.lit(0.5))
    return rows.withColumn("copies", F.col("copies") + F.when(moved, step).otherwise(0))


def _with_error(picked: DataFrame) -> DataFrame:
    """Adds short: the words that the source's taken words miss of its target."""
    error = picked.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    error = materialize(error, "mix-error")
    return picked.alias("p").join(error.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source"))).select("p.*", "short")


def expand_copies(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mixed corpus: each document as often as the plan takes it, with the columns of ``docs``.

    Ids that occur more than once in ``docs`` get the sum of their planned copies
    split over their rows, in no stated order of rows that share an id.
    """
    copies = plan.groupBy(F.col("doc_id").alias("__id")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    names = docs.columns
    joined = docs.join(copies, F.col(doc_id).eqNullSafe(F.col("__id")))
    each = (F.col("__copies") / F.col("__rows")).cast("int") + F.when(F.col("__k") <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    single = joined.where("__rows = 1").withColumn("__n", F.col("__copies").cast("int"))
    many = joined.where("__rows > 1").withColumn("__k", F.row_number().over(Window.partitionBy("__id").orderBy("__id"))).withColumn("__n", each)
    both = single.select(*names, "__n").unionByName(many.select(*names, "__n"))
    return both.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*names)


def op5_mix(spark, sf_dir: str) -> DataFrame:
    """Query: the mix of all documents (weights 5, 2, 1 in turn, 150 % of all words, at most twice a source)."""
    plan = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
