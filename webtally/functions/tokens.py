"""Splitting text into words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A word is a run of anything but white space. With (?U) Java's \s covers the
# Unicode White_Space property; x1c to x1f complete the 29 code points.
WORD = r"(?U)[^\s\x1c-\x1f]+"

# A term starts with a letter, number or underscore and may go on with apostrophes.
TERM = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def tokens(text: Column | str) -> Column:
    """The white-space separated words of a text, in order and never empty."""
    return F.regexp_extract_all(_col(text), F.lit(WORD), 0)


def word_count(text: Column | str) -> Column:
    """Number of words: 0 for a blank text, NULL for NULL whatever the ANSI setting."""
    return F.array_size(tokens(text))


def has_words(text: Column | str) -> Column:
    """Whether a text has any word; stops at the first one."""
    return _col(text).rlike(WORD)


def raw_terms(text: Column | str) -> Column:
    """The terms a word cloud counts, before trimming and merging."""
    return F.regexp_extract_all(_col(text), F.lit(TERM), 0)
