"""The public-suffix rule table: ``rule string, kind string``.

``kind`` is ``std`` for a plain rule, ``wild`` for ``*.rule`` and ``exc`` for ``!rule``.
A rule with letters beyond ASCII is in the table twice, as written and as ``xn--`` name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# The section marks of the published list format.
ICANN_SECTION = r"(?s)===BEGIN ICANN DOMAINS===(.*?)===END ICANN DOMAINS==="
PRIVATE_SECTION = r"(?s)===BEGIN PRIVATE DOMAINS===(.*?)===END PRIVATE DOMAINS==="


# Text of a list beyond this is refused: it is handled on the driver. The published one has 300 kB.
MAX_LIST_BYTES = 64 << 20


def _label_to_ascii(label: str) -> str:
    """An internationalised label as URLs spell it."""
    return label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii")


def suffix_rules(spark: SparkSession, rules: Iterable[str]) -> DataFrame:
    """A rule table from rules in list notation, such as ``com``, ``*.ck`` and ``!www.ck``.

    A rule ends at the first white space; comments start with two slashes. The table is a
    local relation, so nothing is read or computed again by those who use it.
    """
    rows = set()
    for line in rules:
        rule = (line.lower().split() or [""])[0]
        if not rule or rule.startswith("//"):
            continue
        kind = "wild" if rule.startswith("*.") else "exc" if rule.startswith("!") else "std"
        rule = rule.removeprefix("*.").removeprefix("!")
        rows |= {(rule, kind), (".".join(map(_label_to_ascii, rule.split("."))), kind)}
    columns = list(zip(*sorted(rows))) or [(), ()]
    table = {name: pa.array(column, pa.string()) for name, column in zip(("rule", "kind"), columns)}
    return spark.createDataFrame(pa.table(table))


def read_suffix_list(spark: SparkSession, path: str, private: bool = False, marked: bool = True) -> DataFrame:
    """Read a rule table from a file in the published list format.

    Only the ICANN section counts unless ``private`` is set. A file without that section's
    marks is refused, unless ``marked`` is unset: then all its lines are rules.
    """
    files = spark.read.text(path, wholetext=True)
    size = files.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    if size > MAX_LIST_BYTES:
        raise ValueError(f"{path} has {size} bytes, a suffix list at most {MAX_LIST_BYTES}")
    text = "\n".join(row["value"] for row in files.collect())
    if marked:
        sections = re.findall(ICANN_SECTION, text)
        if not sections:
            raise ValueError(f"{path} has no ICANN section; to take all its lines as rules, unset 'marked'")
        text = "\n".join(sections + (re.findall(PRIVATE_SECTION, text) if private else []))
    return suffix_rules(spark, text.splitlines())
