"""Column expressions for words: runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One or more of space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def trimmed(text: Column) -> Column:
    """The text without outer white space; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words_of(trimmed_text: Column) -> Column:
    """Array of words of an already trimmed text."""
    return F.when(trimmed_text == "", F.array().cast("array<string>")).otherwise(F.split(trimmed_text, SPACES))


def n_words_of(trimmed_text: Column) -> Column:
    """Number of words of an already trimmed text, as long."""
    return F.when(trimmed_text == "", F.lit(0)).otherwise(F.size(F.split(trimmed_text, SPACES))).cast("long")
