"""Comments and strings of source code, told apart in one linear pass.

A language's lexer is one alternation of comments, strings and literals. Matched from left to
right it does what a finite-state lexer does: a comment mark inside a string belongs to the string,
a quote inside a comment to the comment. What is blanked becomes spaces, line feeds stay, so
every line and column keeps its place.
"""

from __future__ import annotations

import functools
from functools import reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave import rules as R


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def _replaced(src: Column, pattern: str, how) -> Column:
    """The text with every match of a pattern replaced by ``how(match)``."""
    joined = F.zip_with(F.split(src, pattern, -1), F.regexp_extract_all(src, F.lit(pattern), 0), lambda gap, m: F.concat(gap, F.coalesce(how(m), F.lit(""))))
    return F.when(src.rlike(pattern), F.array_join(joined, "")).otherwise(src)


def _by_language(language: Column, src: Column, of) -> Column:
    found = None
    for lexer in dict.fromkeys(R.LEXERS.values()):
        languages = [x for x, y in R.LEXERS.items() if y == lexer]
        found = (F if found is None else found).when(language.isin(*languages), of(languages[0], *lexer))
    return found.otherwise(src)


def code_of(language: Column, src: Column) -> Column:
    """The source with its comments blanked; strings stay."""

    def blanked(of: str, comment: str, other: str) -> Column:
        shown = reduce(or_, [F.contains(src, F.lit(mark)) for mark in R.COMMENT_MARKS[of]])
        return F.when(shown, _replaced(src, f"{comment}|{other}", lambda m: F.when(m.rlike(rf"\A(?:{comment})\z"), _blank(m)).otherwise(m))).otherwise(src)

    return _by_language(language, src, blanked)


def bare_of(language: Column, code: Column) -> Column:
    """Source without comments, its strings blanked, too. Go's empty types aren't blocks."""
    bare = _by_language(language, code, lambda _, comment, other: _replaced(code, other, _blank))
    return F.when(language == "go", F.regexp_replace(F.regexp_replace(bare, r"\binterface\{\}", " " * 11), r"\bstruct\{\}", " " * 8)).otherwise(bare)


@functools.lru_cache(maxsize=16)
def _built(of, language: str, text: str, context) -> Column:
    return of(F.col(language), F.col(text))


def code(language: str = "language", text: str = "src") -> Column:
    """``code_of`` two columns by name, built once for a session."""
    return _built(code_of, language, text, SparkContext._active_spark_context)


def bare(language: str = "language", text: str = "code") -> Column:
    """``bare_of`` two columns by name, built once for a session."""
    return _built(bare_of, language, text, SparkContext._active_spark_context)
