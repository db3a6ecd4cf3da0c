"""Filter interaction audit: what each filter removes, in every order in which filters can run.

Each document gets a bit mask of the filters that it fails. Counts by part and mask are all
that any order needs: the filter at a step removes the rows that fail it and none before it.

Exact duplicates are found by partition refinement. Documents are split by length in code
points, then by the hashes of successive blocks, each twice as long as the one before;
documents alone in their class drop out after every split. What is left when its text has
run out is compared in full: grouping by class and whole text, copies merge before they are
shuffled, so a large group sends one row for each task. Classes in which hashes met by
accident hold several texts and are taken apart by text.

Lengths, hashes and masks go through the rounds, texts don't. Whole texts are shuffled only
if the classes that are left are too many to broadcast (Spark's own threshold on their size).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let
from .store import materialize
from .words import trimmed, words_of

#: Code points in the first block; each further block has twice as many.
BLOCK = 256


def block_hashes(text: Column, n_chars: Column, first: int = BLOCK, hash_of: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Array of the hashes of successive blocks of a text; empty for an empty text."""
    blocks = F.ceil(F.log2(n_chars / first + 1)).cast("int")
    power = lambda i: F.pow(F.lit(2), i).cast("int")
    block = lambda i: F.substring(text, (power(i) - 1) * first + 1, power(i) * first)
    none = F.array().cast("array<bigint>")
    return F.when(n_chars > 0, F.transform(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), lambda i: hash_of(block(i)))).otherwise(none)


def _chained(cls: Column, block: Column) -> Column:
    return F.xxhash64(cls, block)


def class_of(n_chars: Column, blocks: Column) -> Column:
    """The class that a document is in when its text has run out."""
    return F.aggregate(blocks, n_chars.cast("bigint"), _chained)


def refined(rows: DataFrame) -> DataFrame:
    """Classes (column cls) that more than one row is left in. rows: n_chars, blocks.

    Each round joins the rows with the classes of at least two; the next block's hash splits those.
    """
    alive, done, at = rows.select(F.col("n_chars").cast("bigint").alias("cls"), "blocks"), None, 0
    while True:
        alive = materialize(alive, "audit-alive")
        several = materialize(alive.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls"), "audit-several")
        if several.isEmpty():
            return several if done is None else done
        kept = alive.join(several, "cls")
        ended = kept.where(F.size("blocks") <= at).select("cls").distinct()
        done = materialize(ended if done is None else done.unionByName(ended), "audit-ended")
        alive = kept.where(F.size("blocks") > at).select(_chained(F.col("cls"), F.get("blocks", F.lit(at))).alias("cls"), "blocks")
        at += 1


def duplicate_marks(rows: Callable[[], DataFrame], kept: list[str], first: int = BLOCK, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """id, the columns ``kept`` and is_copy: whether a row with a smaller id has the same text.

    ``rows`` gives the table anew (id, text without nulls, ``kept``); texts are read
    twice, by narrow scans. A null id is no smaller id and makes no copy; rows of equal id and text are no
    copies of each other.
    """

    def keyed() -> DataFrame:
        of = rows().withColumn("n_chars", F.length("text"))
        return of.withColumn("blocks", block_hashes(F.col("text"), F.col("n_chars"), first, hash_of)).withColumn("cls", class_of(F.col("n_chars"), F.col("blocks")))

    narrow = materialize(keyed().select("id", "n_chars", "blocks", "cls", *kept), "audit-rows")
    left = refined(narrow.where("id is not null").select("n_chars", "blocks"))
    plain = narrow.select("id", "cls", *kept)
    if left.isEmpty():
        return plain.select("id", *kept, F.lit(False).alias("is_copy"))
    texts = keyed().where("id is not null").select("id", "cls", "text").join(left, "cls", "left_semi")
    same = texts.groupBy("cls", "text").agg(F.min("id").alias("least"))
    classes = materialize(same.groupBy("cls").agg(F.count(F.lit(1)).alias("n_texts"), F.min("least").alias("least")), "audit-classes")
    one, mixed = classes.where("n_texts = 1").select("cls", "least"), classes.where("n_texts > 1").select("cls")
    is_copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("is_copy")
    if mixed.isEmpty():
        return plain.join(one, "cls", "left").select("id", *kept, is_copy)
    apart = keyed().select("id", "cls", "text", *kept).join(mixed, "cls", "left_semi")
    of_text = apart.join(apart.where("id is not null").groupBy("cls", "text").agg(F.min("id").alias("least")), ["cls", "text"], "left")
    rest = plain.join(mixed, "cls", "left_anti").join(one, "cls", "left")
    return rest.select("id", *kept, is_copy).unionByName(of_text.select("id", *kept, is_copy))


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step. masks: part, mask, n, good, toxic.

    Bit i of ``mask`` says that the rows fail filter ``letters[i]``; n, good and toxic are
    counts. Every part gets all orders and steps; no masks give no rows.
    """
    orders = ["".join(p) for p in itertools.permutations(letters)]
    bits = lambda s: sum((F.when(F.contains(s, F.lit(x)), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(letters)), F.lit(0))
    rows = masks.select("*", F.explode(F.array(*[F.lit(o) for o in orders])).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    rows = rows.withColumn("bit", bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, of="n": F.sum(F.when(cond, F.col(of)).otherwise(F.lit(0))).cast("long")
    # of a mask with m bits, each of its filters is the first in one of m orders
    share = F.expr(f"n * ({len(orders)} div bit_count(mask))")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 100 words), B (repeated words), C (capitals), D (symbols), in this order."""
    n_chars = F.length(text)
    capitals = n_chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    counted = let(words_of(trimmed(text)), lambda w: F.array((F.size(w) < 100), (100 * F.size(F.array_distinct(w)) < 80 * F.size(w))))
    return [counted, 100 * capitals.cast("long") > 10 * n_chars.cast("long"), text.rlike(r"[#$%&*|]")]


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", first: int = BLOCK, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters A to D read a document's own text, E fails copies of a text with a smaller id. A
    null text counts as empty, a null lang as the part "", a null id makes no copy and has no label. Texts of
    any length count whole; rows of equal id and text each count and are no copies of each
    other. Of several labels of an id, any that says good (toxic) counts. An empty table gives
    no rows; other columns of both tables are ignored.
    """
    marked = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))

    def rows() -> DataFrame:
        of = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("part"))
        words, capitals, symbols = text_failures(F.col("text"))
        bit = lambda cond, i: F.when(cond, F.lit(1 << i)).otherwise(F.lit(0))
        return of.withColumn("mask", let(words, lambda w: bit(w[0], 0) + bit(w[1], 1)) + bit(capitals, 2) + bit(symbols, 3))

    found = duplicate_marks(rows, ["part", "mask"], first, hash_of).join(marked, "id", "left")
    mask = F.col("mask") + F.when(F.col("is_copy"), F.lit(16)).otherwise(F.lit(0))
    number = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return audit(found.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), number("good"), number("toxic")), "ABCDE")


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Query: all orders of the five filters over every document."""
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same rows in DuckDB's SQL.
ORACLE = r"""with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by text) as least from d),
m as (select doc_id, part, (len(words) < 100)::int + 2 * (100 * list_unique(words) < 80 * len(words))::int
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as v),
o as (select [a.v, b.v, c.v, d.v, e.v] as vs, a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e where a.v + b.v + c.v + d.v + e.v = 31 and a.v | b.v | c.v | d.v | e.v = 31),
s as (select filter_order, step::int as step, vs[step] as bit, coalesce(list_sum(vs[1:step - 1]), 0)::int as before from o, range(1, 6) t(step)),
r as (select part, filter_order, step, bit,
    sum(case when mask & bit = 0 and mask & before = 0 then n else 0 end)::bigint as kept, sum(case when mask & bit <> 0 and mask & before = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & bit <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant, sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & bit <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost, sum(case when mask & bit <> 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost
  from c, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, bit)::bigint as shapley from r"""
