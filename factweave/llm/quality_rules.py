"""Quality rules: text statistics and a learned decision list over them.

Statistics are per-document column expressions. The decision list is learned by
sequential covering: a rule (a conjunction of threshold conditions) is grown
condition by condition for FOIL's gain on the growing set, pruned from its end on
the pruning set, and kept if it is precise there; what it covers is set aside and
the next rule is grown. The learner only ever sees counts: labelled rows are
binned by quantiles, grouped by their bins into a contingency table, and each
step is one aggregate of it. The list is emitted as an ordered Spark conditional.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .words import SPACE_CHARS, trimmed, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_chars_all", "n_lines", "n_upper", "n_marks")
#: What rules may test, from the statistics; each is a ratio or a count that any text has.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_chars": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "upper_share": lambda: F.col("n_upper") / F.greatest("n_chars_all", F.lit(1)),
    "marks_per_word": lambda: F.col("n_marks") / F.greatest("n_words", F.lit(1)),
    "words_per_line": lambda: F.col("n_words") / F.greatest("n_lines", F.lit(1)),
}


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once: a lambda's variable is never expanded into its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one struct column ``__stats`` with the fields of BASE and EXTRA, all long.

    Null texts count as empty: every statistic is 0.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    hashes = F.transform(words_of(trimmed(F.col(text))), lambda w: F.xxhash64(w))
    starts = lambda h: F.when(F.size(h) >= WINDOW, F.sequence(F.lit(1), F.size(h) - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    windows = lambda h: F.transform(starts(h), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    by_word = let(
        hashes,
        lambda h: F.struct(
            F.size(h).alias("n_words"),
            let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _repeated(w)).otherwise(F.lit(0))).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.withColumn("__w", by_word).withColumn("__l", by_line)
    stats = {
        "n_words": F.col("__w.n_words"),
        "word_chars": F.length(F.translate(raw, SPACE_CHARS, "")),
        "n_symbols": F.length(F.regexp_replace(raw, f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.col("__l.n_dup_lines"),
        "n_repeat_words": F.col("__w.n_repeat_words"),
        "n_chars_all": F.length(raw),
        "n_lines": F.col("__l.n_lines"),
        "n_upper": F.length(F.regexp_replace(raw, "[^A-Z]+", "")),
        "n_marks": F.length(F.regexp_replace(raw, "[^!?]+", "")),
    }
    return out.withColumn("__stats", F.struct(*[c.cast("long").alias(k) for k, c in stats.items()])).drop("__w", "__l")


def _repeated(windows: Column) -> Column:
    """Number of word positions under windows whose hash occurs twice or more.

    Sorting (hash, start) puts equal windows side by side; the starts of those are
    sorted again, and each covers the words up to the next start, at most WINDOW.
    """
    sorted_pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda pairs, k, p: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
    twice = let(
        sorted_pairs,
        lambda pairs: F.filter(
            F.transform(pairs, lambda p, k: F.when(same(pairs, k - 1, p) | same(pairs, k + 1, p), p["i"])),
            lambda i: i.isNotNull(),
        ),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        F.sort_array(twice),
        zero,
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n")),
        lambda a: a["n"],
    )


def base_failed(stats: Column) -> Column:
    """The fixed part of the verdict: very short, or mostly repeated words."""
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    """``feature <= threshold`` or ``feature > threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects a document."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _bins(grid: dict[str, list[float]]) -> list[Column]:
    """For each feature the number of grid values below its value."""

    def below(f: str) -> Column:
        value = FEATURES[f]()
        return F.size(F.filter(F.array(*[F.lit(x) for x in grid[f]]).cast("array<double>"), lambda t: t < value))

    return [below(f).alias(f"b_{f}") for f in FEATURES]


def learn(
    stats: DataFrame,
    grid_size: int = 32,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.95,
    min_support: int = 10,
) -> list[Rule]:
    """Rules that reject, in order, from rows of statistics with ``bad`` (boolean) and ``fold`` (0..2).

    Fold 2 prunes, the others grow. All labelled rows count; what reaches the driver
    is the quantile grid and, for each step, one count for each feature and bin
    (at most ``len(FEATURES) * (grid_size + 1) * 4`` rows).
    Ties between conditions go by feature order, then threshold, then direction.
    """
    probs = [(i + 1) / (grid_size + 1) for i in range(grid_size)]
    spec = []
    for f in FEATURES:
        v = FEATURES[f]()
        # quantiles of either class, so that a rare class has thresholds of its own
        spec += [F.percentile_approx(F.when(F.col("bad"), v), probs[::2]).alias(f"p_{f}"), F.percentile_approx(F.when(~F.col("bad"), v), probs[::2] + [0.99, 0.999, 1.0]).alias(f"n_{f}")]
    row = stats.agg(*spec).first()
    grid = {f: sorted({*(row[f"p_{f}"] or ()), *(row[f"n_{f}"] or ())}) for f in FEATURES}
    if not any(grid.values()):
        return []
    names = [f"b_{f}" for f in FEATURES]
    table = materialize(
        stats.select(*_bins(grid), "bad", (F.col("fold") == 2).alias("prune")).groupBy(*names, "bad", "prune").agg(F.count(F.lit(1)).alias("n")), "rules-bins"
    )
    rules: list[tuple] = []
    left = table
    while len(rules) < max_rules:
        rule = _pruned(left, _grown(left, grid, max_conditions), min_precision, min_support)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~_covers(rule))
    return [Rule(tuple(Condition(f, above, grid[f][b]) for f, above, b in rule)) for rule in rules]


def _covers(rule: tuple) -> Column:
    """The rule over bins: bin <= b means value <= grid[b]; the conditions are (feature, above, b)."""
    out = F.lit(True)
    for f, above, b in rule:
        out = out & (F.col(f"b_{f}") > b if above else F.col(f"b_{f}") <= b)
    return out


def _grown(left: DataFrame, grid: dict, max_conditions: int) -> tuple:
    rule: tuple = ()
    while len(rule) < max_conditions:
        rows = (
            left.where(_covers(rule) & ~F.col("prune"))
            .select("bad", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES])).alias("x"))
            .groupBy("x.f", "x.b", "bad")
            .agg(F.sum("n").alias("n"))
            .collect()  # features times bins times 2 at most
        )
        count = {(r["f"], r["b"], r["bad"]): r["n"] for r in rows}
        first = next(iter(FEATURES))
        p0 = sum(n for (f, _, bad), n in count.items() if f == first and bad)
        n0 = sum(n for (f, _, bad), n in count.items() if f == first and not bad)
        if not p0 or not n0:
            break
        best = (0.0, None)
        for f in FEATURES:
            p = n = 0
            for b in range(len(grid[f])):
                p, n = p + count.get((f, b, True), 0), n + count.get((f, b, False), 0)
                for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                    if pp:
                        gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, above, b))
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def _pruned(left: DataFrame, rule: tuple, min_precision: float, min_support: int) -> tuple:
    """The shortest head of the rule that is best on the pruning set; empty if it isn't precise on both sets."""
    if not rule:
        return ()
    heads = [rule[: k + 1] for k in range(len(rule))]
    spec = []
    for k, head in enumerate(heads):
        for name, cond in (("p", F.col("bad")), ("n", ~F.col("bad"))):
            for at, fold in (("g", ~F.col("prune")), ("t", F.col("prune"))):
                spec.append(F.coalesce(F.sum(F.when(_covers(head) & cond & fold, F.col("n"))), F.lit(0)).alias(f"{name}{at}{k}"))
    row = left.agg(*spec).first()
    worth = [(row[f"pt{k}"] - row[f"nt{k}"]) / max(1, row[f"pt{k}"] + row[f"nt{k}"]) for k in range(len(heads))]
    k = max(range(len(heads)), key=lambda k: (round(worth[k], 6), -k))
    p, n = row[f"pg{k}"] + row[f"pt{k}"], row[f"ng{k}"] + row[f"nt{k}"]
    precise = all(a >= min_precision * (a + b) for a, b in ((row[f"pg{k}"], row[f"ng{k}"]), (row[f"pt{k}"], row[f"nt{k}"])))
    return heads[k] if precise and p >= min_support and p + n else ()


def verdict(stats: Column | None, rules: list[Rule]) -> Column:
    """Ordered conditional: the first rule that holds rejects; else the document stays."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> tuple[DataFrame, list[Rule]]:
    """(verdicts, rules): doc_id, the statistics, base_failed and kept for each input row.

    ``labels`` (doc_id, ``label`` 1 good or 0 bad, null ignored) train the rules; an id
    that is labelled more than once counts as bad if any label says so. Documents that
    the base already fails aren't learned from. Without usable labels no rule is
    learned and the base decides alone. Null or empty texts fail the base. Repeated
    rows are judged one by one; an empty table gives no rows; other columns of
    either table are ignored.
    """
    s = with_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    s = materialize(s.select("doc_id", "__stats.*", base_failed(F.col("__stats")).alias("base_failed")), "rules-stats")
    rules: list[Rule] = []
    if labels is not None:
        marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(label) == 0).alias("bad"))
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold")
        rules = learn(s.where(~F.col("base_failed")).join(marks, "doc_id").withColumn("fold", fold), **options)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(None, rules))
    return s.withColumn("kept", kept), rules


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; the rules are learned as in ``judge``.

    Labels are joined with statistics, so no text is shuffled; the verdict is a filter of the scan.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(label) == 0).alias("bad"))
    known = with_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).where(~base_failed(F.col("__stats"))).select("doc_id", "__stats.*")
    known = known.join(marks, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3))).drop("doc_id")
    rules = learn(materialize(known, "rules-known"), **options)
    rows = with_statistics(docs.select(F.struct("*").alias("__row"), F.col(text).alias("text"))).select("__row", "__stats.*", base_failed(F.col("__stats")).alias("__failed"))
    return rows.where(~F.col("__failed") & verdict(None, rules)).select("__row.*")


def op2_rules(spark, sf_dir: str) -> DataFrame:
    """Query: statistics and verdict of every document, with rules learned from ``labels``."""
    out, _ = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *BASE, "base_failed", "kept")
