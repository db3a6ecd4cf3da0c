"""Where functions end, and which function a line is in.

Every bracket, and in Ruby every word that opens or closes a block, gets its depth by a
running sum over its file. An opening bracket and the next mark of the same depth are a pair, so
a function's body is found by looking one and two marks ahead among those of its own depth. In
Python a line that is indented less than the one before closes the depths between.

Facts find their function by an as-of join with the boundaries of functions: after a start the function
itself is the innermost one, after an end the function around it, which is the last one
to start one nesting level below. All of it is windows by file: linear after the sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave import rules as R
from factweave.operators import extract

#: After everything else on a line.
_LINE_END = 1 << 29
#: Bytes of source for each task: lines and marks that are sorted together take about 100 times as much memory.
TASK_TEXT = 4 << 20


def parts_of(files: DataFrame) -> int:
    """Into how many tasks the rows of ``files`` are dealt: one for each TASK_TEXT bytes of source, and every core has one."""
    size = files.agg(F.sum(F.octet_length("src")).alias("n")).first()["n"] or 0
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT))


def _bracket_ends(lines: DataFrame) -> DataFrame:
    """Symbols (file, line, s, at, one_line, end, end_k) of languages with brackets or block words; ``lines`` are with_symbols."""
    ruby = F.col("language") == "ruby"
    found = F.when(ruby, F.regexp_extract_all("text", F.lit(R.RUBY_BLOCKS), 0)).otherwise(F.regexp_extract_all("text", F.lit(R.BRACKETS), 0))
    # of each line a row for its symbol (number 0), then one for every mark
    rows = lines.select("file", "line", "s", "at", "one_line", ruby.alias("ruby"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), found)).alias("n", "mark"))
    own = F.col("n") == 0
    closes = F.when(F.col("ruby"), F.trim("mark") == "end").otherwise(F.col("mark").isin("}", ")", "]"))
    kind = F.when(own, F.lit("s")).when(~F.col("ruby"), F.col("mark")).when(closes, F.lit("}")).otherwise(F.lit("{"))
    delta = F.when(own | (F.col("mark") == ";"), F.lit(0)).when(closes, F.lit(-1)).otherwise(F.lit(1))
    told = [F.when(own, F.col(c)).alias(c) for c in ("s", "one_line")]
    rows = rows.where("n > 0 or s is not null").select("file", "line", F.when(own, F.col("at")).otherwise(F.col("n") - 1).alias("k"), F.when(own, F.lit(0)).otherwise(F.lit(1)).alias("tag"), delta.alias("delta"), kind.alias("kind"), *told)
    order = ["line", "k", "tag"]
    depth = F.sum("delta").over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("after", depth)
    rows = rows.withColumn("level", F.when(F.col("delta") == 1, F.col("after") - 1).otherwise(F.col("after"))).where("kind in ('s', '{', '}', ';')")
    ahead = Window.partitionBy("file", "level").orderBy(*order)
    place = F.struct("kind", "line", "k")
    rows = rows.select("*", F.lead(place, 1).over(ahead).alias("a"), F.lead(place, 2).over(ahead).alias("b")).where("kind = 's'")
    end = F.when(F.col("a.kind") == "{", F.when(F.col("b.kind") == "}", F.col("b")).otherwise(F.struct(F.lit("}").alias("kind"), F.lit(_LINE_END).cast("long").alias("line"), F.lit(0).alias("k"))))
    end = end.when(F.col("a.kind") == ";", F.col("a"))
    return rows.select("file", "line", "s", F.col("k").alias("at"), "one_line", F.coalesce(end["line"], "line").alias("end"), F.coalesce(end["k"], F.lit(_LINE_END)).alias("end_k"))


def _indent_ends(lines: DataFrame) -> DataFrame:
    """The same for Python: up to the line before the next one that is indented no more than the definition."""
    by_file = Window.partitionBy("file").orderBy("line")
    count = lambda p: F.length("text") - F.length(F.regexp_replace("text", p, ""))
    before = F.coalesce(F.sum(count(r"[(\[{]") - count(r"[)\]}]")).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    glued = F.coalesce(F.lag("text").over(by_file).rlike(r"\\\s*$"), F.lit(False))
    indent = F.length(F.regexp_extract("text", r"^([ \t]*)", 1))
    sym = F.struct("s", "at", "one_line")
    real = lines.withColumn("sym", sym).select("file", "line", "text", "sym", F.lead("sym").over(by_file).alias("below"), before.alias("open"), glued.alias("glued")).where("open <= 0 and not glued and trim(text) <> ''")
    # the line after the last one closes all depths
    here, last = F.struct("line", indent.alias("indent"), "sym"), F.struct((F.col("line") + 1).alias("line"), F.lit(0).alias("indent"), F.col("below").alias("sym"))
    ends = F.lead("line").over(by_file).isNull()
    real = real.withColumn("ends", ends).select("file", F.explode(F.when(F.col("ends"), F.array(here, last)).otherwise(F.array(here))).alias("r")).select("file", "r.line", "r.indent", "r.sym")
    real = real.select("*", F.lag("indent").over(by_file).alias("was"), F.lag("line").over(by_file).alias("end"), F.lead("indent").over(by_file).alias("next"))
    # of each line a row for its symbol (number 0), then one for every depth that it closes
    closed = F.when(F.col("was") > F.col("indent"), F.sequence(F.col("indent"), F.col("was") - 1)).otherwise(F.array().cast("array<int>"))
    rows = real.select("*", F.posexplode(F.concat(F.array("indent"), closed)).alias("n", "level")).where("n > 0 or sym.s is not null")
    own = F.col("n") == 0
    rows = rows.select("file", "line", "level", F.when(own, F.lit(1)).otherwise(F.lit(0)).alias("tag"), F.when(~own, F.col("end")).alias("end"), F.when(own, F.col("sym")).alias("sym"), (F.col("next") > F.col("indent")).alias("has"))
    found = rows.select("*", F.lead("end").over(Window.partitionBy("file", "level").orderBy("line", "tag")).alias("close")).where("tag = 1")
    return found.select("file", "line", "sym.*", F.when(F.col("has"), F.coalesce("close", "line")).otherwise(F.col("line")).alias("end"), F.lit(_LINE_END).alias("end_k"))


def scopes(files: DataFrame, parts: int | None = None) -> DataFrame:
    """name, kind, file, line, is_exported, at, end_line, end_k of every symbol: from its line to the one that ends it.

    A declaration without a body ends with its statement; where brackets don't match, with its file. Sources are dealt
    by file to ``parts`` tasks; lines, marks and symbols stay where their file is.
    """
    texts = files.select("file", "language", "bare") if "bare" in files.columns else files
    lines = extract.with_symbols(extract.bare_lines(texts.repartition(parts or parts_of(files), "file")))
    python = F.col("language") == "python"
    rows = _bracket_ends(lines.where(~python)).unionByName(_indent_ends(lines.where(python)))
    end = F.when(F.col("one_line"), F.col("line")).otherwise(F.greatest("end", "line"))
    return rows.select("s.name", "s.kind", "file", "line", "s.is_exported", "at", end.alias("end_line"), F.when(F.col("one_line"), F.lit(_LINE_END)).otherwise(F.col("end_k")).alias("end_k"))


def boundaries(spans: DataFrame, kinds=("function",)) -> DataFrame:
    """file, line, n, name: from this line on (the last n of a line counts) ``name`` is the innermost, null for none."""
    own = spans.where(F.col("kind").isin(*kinds))
    start = F.struct("line", F.col("at").alias("k"), F.lit(1).alias("delta"), "name")
    stop = F.struct(F.col("end_line").alias("line"), (F.col("end_k") + 1).alias("k"), F.lit(-1).alias("delta"), F.lit(None).cast("string").alias("name"))
    order = ["line", "k", "delta"]
    rows = own.select("file", F.explode(F.array(start, stop)).alias("r")).select("file", "r.*")
    nest = F.sum("delta").over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # an end leads back to the last function that started at the nesting level it returns to
    around = Window.partitionBy("file", "nest").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nest", nest).withColumn("inner", F.when(F.col("nest") > 0, F.last("name", ignorenulls=True).over(around)))
    # an end takes effect on the next line, unless another function starts after it on its own
    later = F.max(F.when(F.col("delta") == 1, F.col("k"))).over(Window.partitionBy("file", "line"))
    rows = rows.withColumn("later", later).where("delta = 1 or later is null or later < k")
    number = F.row_number().over(Window.partitionBy("file").orderBy(*order))
    return rows.select("file", F.when(F.col("delta") == 1, F.col("line")).otherwise(F.col("line") + 1).alias("line"), number.alias("n"), F.col("inner").alias("name"))


def enclosing(facts: DataFrame, spans: DataFrame, file: str = "file", name: str = "fn_name", kinds=("function",), parts: int | None = None) -> DataFrame:
    """Each fact gets the name of the innermost function around its line; else its name stays.

    With ``parts`` (see ``parts_of``) facts and spans are dealt by file to so many tasks.
    """
    if parts is not None:
        spans = spans.repartition(parts, "file")
    marks = boundaries(spans, kinds).select(F.col("file").alias("__file"), F.col("line").alias("__line"), F.col("n").alias("__n"), F.struct(F.col("name").alias("inner")).alias("__name"))
    rows = facts.select(F.struct("*").alias("__row"), F.col(file).alias("__file"), F.col("line").alias("__line"))
    none = F.lit(None).cast(marks.schema["__name"].dataType)
    both = rows.select("*", F.lit(_LINE_END).alias("__n"), none.alias("__name")).unionByName(marks.select(F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "*"))
    if parts is not None:
        both = both.repartition(parts, "__file")
    before = Window.partitionBy("__file").orderBy("__line", "__n").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__name", ignorenulls=True).over(before)).where("__row is not null")
    return found.select("__row.*", "__found").withColumn(name, F.coalesce("__found.inner", name)).drop("__found")


def enclosing_edges(edges: DataFrame, spans: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges without a source symbol get the innermost function or class around their line."""
    own = edges.where("src_symbol is not null or line is null")
    return own.unionByName(enclosing(edges.where("src_symbol is null and line is not null"), spans, "src_file", "src_symbol", ("function", "class"), parts))
