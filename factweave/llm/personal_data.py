"""Personal data: identifiers by pattern, and terms that disclose them.

Secrets (access keys, values assigned to a password or key) are found by pattern, too, and
protected like identifiers. Identifiers (e-mail, IP address, payment card, phone) are found by pattern. Words that
keep appearing beside one of them can give it away after it is masked. How strongly
a term t reveals an identifier e is estimated from the corpus by pointwise mutual
information, PMI(e;t) = log2(N * n(e,t) / (n(e) * n(t))), over the information of the
identifier itself, IC(e) = log2(N / n(e)). A term whose share PMI / IC reaches the
disclosure threshold is treated as personal data wherever it stands in a text with
that identifier. Identifiers are replaced by their kind, terms by a placeholder.

n(e,t) counts different texts with t within a few words of e, n(e) different texts
with e, n(t) different texts with t anywhere, N different texts. Each identifier
contributes a bounded number of context words, so the tables are linear in the input.
So is the join of texts with revealing terms by term: a term of share s is beside e in
at least (n(e) / N)^(1 - s) of all texts that have it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let
from .store import materialize

KINDS = ("email", "ip", "card", "phone", "term", "secret")
TERM_KIND, SECRET_KIND = 4, 5
#: Context from which is estimated: so many terms on each side, within so many characters.
CONTEXT_TERMS, CONTEXT_CHARS, NEAR = 6, 96, 64
#: Disclosure: least share of the identifier's information, and different texts that show it.
DISCLOSURE, SUPPORT = 0.9, 3

_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TERM = r"\p{L}{3,}"
#: Patterns that find the same matches as the plain ones, in linear time (a match can
#: only start where a run of its first class starts, or where the last match ended).
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Public formats of access keys, private keys, and a value with a digit that is assigned to a secret's name: fixed values.
SECRET = (
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[=:]\x20*[\"']?(?=[^\x20\x09-\x0D\"']*[0-9])[^\x20\x09-\x0D\"']{8,}"
)
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def running(values: Column, op: Callable[[Column, Column], Column], start: int) -> Column:
    """Array of the folds of all values before each one; in blocks of sqrt(n), so n^1.5 steps."""
    fold = lambda part: F.aggregate(part, F.lit(start).cast("bigint"), lambda s, x: op(s, x).cast("bigint"))

    def in_blocks(v: Column) -> Column:
        return let(F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1)), lambda b: let(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / b).cast("int")), lambda k: fold(F.slice(v, k * b + 1, b))), lambda sums: of(v, b, sums)))

    def of(v: Column, b: Column, sums: Column) -> Column:
        # what is before a block, then what is before a value in its block
        before = F.transform(sums, lambda _, k: fold(F.slice(sums, F.lit(1), k)))
        return let(before, lambda base: F.transform(v, lambda _, i: op(F.get(base, F.floor(i / b).cast("int")), fold(F.slice(v, F.floor(i / b).cast("int") * b + 1, i % b))).cast("bigint")))

    return let(values, lambda v: F.when(F.size(v) > 0, in_blocks(v)).otherwise(F.array().cast("array<bigint>")))


#: Characters of a block of a text.
BLOCK = 4096


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points: parts of it are cut from these in time linear in their own length."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), 0)


def part_of(blocks: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (counted from 0) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + F.greatest(size, F.lit(1)) - 1) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (start - first * BLOCK + 1).cast("int"), size.cast("int"))


def spans_of(text: Column, pattern: str, kind: int, offset: Column | None = None, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, kind, end, value) of all (wanted) matches; code points, end exclusive.

    The matches and the gaps between them alternate, so their lengths add up to positions.
    """
    zero = F.lit(0) if offset is None else offset

    def placed(found: Column) -> Column:
        pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size")))
        pairs = F.slice(pairs, 1, F.size(found))
        at = lambda p: running(F.transform(p, lambda x: x["gap"] + x["size"]), lambda a, b: a + b, 0)
        span = lambda x, before: F.struct(
            (zero + before + x["gap"]).cast("int").alias("start"), F.lit(kind).alias("kind"), (zero + before + x["gap"] + x["size"]).cast("int").alias("end"), x["match"].alias("value")
        )
        return let(pairs, lambda p: F.zip_with(p, at(p), span))

    none = F.array().cast(f"array<{_SPAN}>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
    return found if wanted is None else F.filter(found, lambda x: wanted(x["value"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def digit(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + digit(i))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """All identifiers of a text, by start, then kind."""
    valid = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda v: F.length(_digits(v)).between(14, 19) & _luhn(_digits(v)),
        "phone": lambda v: F.length(_digits(v)).between(10, 15),
    }
    gate = {"email": text.contains("@"), "ip": F.lit(True), "card": F.lit(True), "phone": text.contains("+")}
    none = F.array().cast(f"array<{_SPAN}>")
    checked = lambda k, i: F.filter(spans_of(text, PATTERNS[k], i), lambda s: valid[k](s["value"]))
    found = [F.when(gate[k], checked(k, i)).otherwise(none) for i, k in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*found))


def protected_spans(text: Column, base: Column) -> Column:
    """Identifiers, and secrets that overlap none of them, by start."""
    return F.when(text.rlike(SECRET), beside_all(spans_of(text, SECRET, SECRET_KIND), base)).otherwise(base)


def entity_of(span: Column) -> Column:
    """What counts as the same identifier: kind and value without case or punctuation."""
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"].isin(1, SECRET_KIND), span["value"]).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), value)


def outside(terms: Column, base: Column) -> Column:
    """The spans (few) that overlap no identifier (of few)."""
    return F.filter(terms, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def beside_all(more: Column, base: Column) -> Column:
    """``base`` and those of ``more`` that overlap none of it, by start."""
    marked = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b.alias("s"), F.lit(False).alias("new"))), F.transform(more, lambda m: F.struct(m.alias("s"), F.lit(True).alias("new")))))

    def kept(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: F.when(r["new"], F.lit(0)).otherwise(r["s"]["end"])), F.greatest, 0)
        starts = F.reverse(running(F.reverse(F.transform(rows, lambda r: F.when(r["new"], F.lit(1 << 30)).otherwise(r["s"]["start"]))), F.least, 1 << 30))
        free = F.zip_with(F.zip_with(rows, ends, lambda r, e: F.struct(r.alias("r"), e.alias("e"))), starts, lambda x, s: F.struct(x["r"].alias("r"), (~x["r"]["new"] | ((x["e"] <= x["r"]["s"]["start"]) & (s >= x["r"]["s"]["end"]))).alias("ok")))
        return F.transform(F.filter(free, lambda x: x["ok"]), lambda x: x["r"]["s"])

    return F.when(F.size(more) > 0, let(marked, kept)).otherwise(base)


def context_of(blocks: Column, size: Column, span: Column, base: Column) -> Column:
    """Term spans beside an identifier, outside of the identifiers near it. blocks, size: of its text."""
    lo = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    # Each window is read with the identifier's own first or last character, so a word needs a
    # character that is no letter on both sides. One that the window's other edge may have cut is
    # left out; the text's own edges cut nothing, there a space stands in.
    whole = rf"(?<=\P{{L}}){TERM}(?=\P{{L}})"
    edge = F.when(lo == 0, F.lit(" ")).otherwise(F.lit(""))
    before = spans_of(F.concat(edge, part_of(blocks, lo, span["start"] - lo + 1)), whole, 4, lo - F.length(edge))
    tail = part_of(blocks, span["end"] - 1, F.least(F.lit(CONTEXT_CHARS + 1), size - span["end"] + 1))
    after = spans_of(F.concat(tail, F.when(F.length(tail) <= CONTEXT_CHARS, F.lit(" ")).otherwise(F.lit(""))), whole, 4, span["end"] - 1)
    last = let(before, lambda b: F.slice(b, F.greatest(F.size(b) - CONTEXT_TERMS + 1, F.lit(1)), CONTEXT_TERMS))
    first = F.slice(after, 1, CONTEXT_TERMS)
    return let(base, lambda near: outside(F.concat(last, first), near))


def terms_of(text: Column) -> Column:
    """Array of the distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), 0)), F.lower))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, text_hash, base (spans), spans (base, secrets and disclosing terms) for each input row.

    A span is (start, kind, end, value), code points, end exclusive; kind indexes KINDS.
    A null text counts as empty and has no spans; texts of any length count whole. Of spans
    that overlap, identifiers win over secrets and both over terms; a share equal to the threshold discloses. Rows equal in id and text get equal
    results; repeated texts count once as evidence. An empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t"))).withColumn("held", protected_spans(F.col("t"), F.col("base")))
    # by their shortest lengths, no more than NEAR spans of all kinds to either side can reach into a span's context
    around = lambda s, i: F.filter(F.slice("held", F.greatest(i + 1 - NEAR, F.lit(1)), 2 * NEAR + 1), lambda b: (b["end"] > s["start"] - CONTEXT_CHARS) & (b["start"] < s["end"] + CONTEXT_CHARS))
    near = let(blocks_of(F.col("t")), lambda b: F.transform("held", lambda s, i: F.struct(entity_of(s).alias("entity"), context_of(b, F.length("t"), s, around(s, i)).alias("terms"))))
    has = F.size("held") > 0
    found = rows.select("doc_id", F.xxhash64("t").alias("text_hash"), "base", "held", F.when(has, near).alias("near"), F.when(has, terms_of(F.col("t"))).alias("terms"))
    found = materialize(found, "pii-base")

    seen = found.where("near is not null").select("text_hash", F.explode("near").alias("x")).select("text_hash", "x.entity", "x.terms")
    beside = seen.select("text_hash", "entity", F.explode("terms").alias("span")).select("text_hash", "entity", F.lower("span.value").alias("term"))
    of_entity = seen.groupBy("entity").agg(F.countDistinct("text_hash").alias("n_e")).where(F.col("n_e") >= support)
    pairs = beside.distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    pairs = materialize(pairs.join(of_entity, "entity"), "pii-pairs")
    if pairs.isEmpty():
        return found.select("doc_id", "text_hash", "base", F.col("held").alias("spans"))

    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    n = found.select("text_hash").distinct().count()
    information = F.log2(F.lit(float(n)) / F.col("n_e"))
    mutual = lambda n_t: F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col(n_t)))
    # A term is in no fewer texts than in those with an identifier. Pairs that fail by that number already go, so few
    # terms are left to be counted in all texts.
    near = found.where("near is not null").select("text_hash", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))
    pairs = materialize(pairs.join(near, "term").where((information > 0) & (mutual("n_least") >= disclosure * information)).select(*pairs.columns), "pii-possible")
    if pairs.isEmpty():
        return found.select("doc_id", "text_hash", "base", F.col("held").alias("spans"))
    asked = materialize(pairs.select("term").distinct(), "pii-terms")
    of_term = texts.select("text_hash", F.explode(terms_of(F.col("t"))).alias("term")).join(asked, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    revealing = pairs.join(of_term, "term").where(mutual("n_t") >= disclosure * information).select("entity", "term")
    revealing = materialize(revealing, "pii-revealing")
    # Every term of the texts with an identifier, held against the terms that reveal one of its own.
    held = found.where("near is not null").select("text_hash", F.explode("terms").alias("term")).distinct()
    held = held.join(revealing, "term").join(seen.select("text_hash", "entity").distinct(), ["text_hash", "entity"], "left_semi")
    held = materialize(held.groupBy("text_hash").agg(F.collect_set("term").alias("wanted")), "pii-held")  # of one text
    places = spans_of(F.col("t"), TERM, 4, wanted=lambda m: F.array_contains("wanted", F.lower(m))).alias("added")
    added = texts.join(held, "text_hash").select("text_hash", places).dropDuplicates(["text_hash"])
    marked = found.alias("f").join(added.alias("a"), "text_hash", "left")
    none = F.array().cast(f"array<{_SPAN}>")
    spans = beside_all(F.coalesce("a.added", none), F.col("f.held"))
    return marked.select("f.doc_id", "text_hash", "f.base", spans.alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced: identifiers by their kind, terms removed to a placeholder."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def joined(blocks: Column, before: Column) -> Column:
        pieces = F.zip_with(spans, before, lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(part_of(blocks, at, s["start"] - at), F.get(labels, s["kind"]))))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), part_of(blocks, end, F.length(text) - end))

    # each span starts after the furthest end before it, or goes with that one
    return F.when(F.size(spans) > 0, let(blocks_of(text), lambda b: let(running(F.transform(spans, lambda s: s["end"]), F.greatest, 0), lambda at: joined(b, at)))).otherwise(text)


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with personal data masked in the text; null texts stay null."""
    names = docs.columns
    spans = find_personal_data(docs, doc_id, text, **options).where(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__hash"])
    hashed = docs.withColumn("__hash_own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = hashed.join(spans, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__hash_own") == F.col("__hash")), "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNotNull(), masked(F.col(text), F.col("__spans"))).otherwise(F.col(text))).select(*names)


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    """Query: personal data of every document."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *[number(i) for i in range(4)], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
