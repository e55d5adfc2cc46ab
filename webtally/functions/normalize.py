"""Orthographic normalisation as one column expression built from ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Translate(NamedTuple):
    """Replace single characters one for one."""

    source: str
    target: str


class Replace(NamedTuple):
    """Replace every occurrence of a string."""

    source: str
    target: str


class ReplaceRegex(NamedTuple):
    """Replace every match of a Java regular expression.

    ``only_if`` is a string that every match contains. Texts without it are passed
    on after a plain search, which is several times cheaper than the expression. A
    string that some match lacks changes the result.
    """

    pattern: str
    replacement: str
    only_if: str | None = None


Rule = Translate | Replace | ReplaceRegex


# Digits of the Arabic-script numeral systems and of Latin script.
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
EXTENDED_ARABIC_INDIC = "۰۱۲۳۴۵۶۷۸۹"
LATIN = "0123456789"

ZWNJ = "\N{ZERO WIDTH NON-JOINER}"
TATWEEL = "\N{ARABIC TATWEEL}"

NUMERALS = Translate(ARABIC_INDIC + EXTENDED_ARABIC_INDIC, LATIN + LATIN)

# The rules for Sorani in Arabic script. The order matters.
SORANI_LETTERS = Translate("كيى", "کیی")
SORANI_ARABIC: tuple[Rule, ...] = (
    # No later rule tells one digit from another, so letters and digits share a pass.
    Translate(SORANI_LETTERS.source + NUMERALS.source, SORANI_LETTERS.target + NUMERALS.target),
    Replace("ه" + ZWNJ, "ە"),
    Replace(TATWEEL, ""),
    # At the start of a word. The letter comes first in the pattern, so the look-behind
    # only runs where it was found.
    ReplaceRegex(r"ر(?<![\p{L}\p{M}\p{N}]ر)", "ڕ", only_if="ر"),
    ReplaceRegex(" {2,}", " ", only_if="  "),
)


def _apply(text: Column, rule: Rule) -> Column:
    if isinstance(rule, Translate):
        return F.translate(text, rule.source, rule.target)
    if isinstance(rule, Replace):
        return F.replace(text, F.lit(rule.source), F.lit(rule.target))
    if rule.only_if is None:
        return F.regexp_replace(text, rule.pattern, rule.replacement)

    def guarded(t: Column) -> Column:
        return F.when(t.contains(rule.only_if), F.regexp_replace(t, rule.pattern, rule.replacement)).otherwise(t)

    # The text so far is bound once: used three times it would triple the expression with every rule.
    return F.get(F.transform(F.array(text), guarded), F.lit(0))


def normalize_text(text: Column | str, rules: Sequence[Rule] = SORANI_ARABIC) -> Column:
    """Apply ``rules`` in order. All of them stay in a single projection."""
    return reduce(_apply, rules, F.col(text) if isinstance(text, str) else text)


def unify_numerals(text: Column | str) -> Column:
    """Write Arabic-Indic and Extended Arabic-Indic digits as 0 to 9."""
    return normalize_text(text, (NUMERALS,))
