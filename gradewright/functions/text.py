"""Text expressions: every function takes columns and returns one, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_count(text) -> Column:
    """Runs of letters, digits and underscores, and every other visible character; null for null."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def words(text) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(word_array: Column, n: int) -> Column:
    """The runs of n words as strings; an empty array if there are fewer. word_array should be a stored column, as each run reads it."""
    runs = F.transform(F.sequence(F.lit(1), F.size(word_array) - n + 1), lambda i: F.array_join(F.slice(word_array, i, F.lit(n)), " "))
    return F.when(F.size(word_array) >= n, runs).otherwise(F.array().cast("array<string>"))


def dehyphenate(text) -> Column:
    """Words broken over a line end joined without their hyphen."""
    return F.regexp_replace(text, r"([A-Za-z])-\n([a-z])", "$1$2")


def chrome_form(line) -> Column:
    """Trimmed, lower-cased, digits as #, white space reduced: equal for all instances of a running line."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), "[0-9]", "#"), r"\s+", " ")


def sentences(text) -> Column:
    """The text cut after . ! ? and white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def text_form(text) -> Column:
    """White space reduced, lower-cased: the identity of stems and scenarios."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def line_kind(line) -> Column:
    """table, example or prose; null for a blank line."""
    return (
        F.when(F.trim(line) == "", F.lit(None)).when(line.contains(" | "), "table")
        .when(line.rlike(r"(?i)^\s*(example|illustration|case)\b"), "example").otherwise("prose")
    )


def table_row(cells: Column) -> Column:
    """Cells joined by pipes, trimmed, nulls as empty cells."""
    return F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")


def distinct_union(arrays: Column) -> Column:
    """An array of arrays flattened in order, later repeats and nulls dropped."""
    return F.array_distinct(F.filter(F.flatten(F.filter(arrays, lambda a: a.isNotNull())), lambda x: x.isNotNull()))
