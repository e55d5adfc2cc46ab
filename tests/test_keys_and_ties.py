"""Repeated keys, and the most frequent text of ties."""

import random
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from webtally.operators import dedup as dd, profile as pf

REPEATED = {
    "first key of two texts": [(1, "a"), (1, "b"), (2, "b")],
    "first key on a later copy": [(1, "a"), (2, "b"), (2, "a")],
    "key of later copies only": [(1, "a"), (2, "a"), (2, "a")],
    "a key of many texts": [(1, t) for t in "abcdefgh"] + [(2, t) for t in "abcdefgh"] + [(0, "h"), (2, None), (3, None)],
}
SAME_ROW = [(1, "a"), (1, "a"), (2, "b")]


def brute_flags(rows):
    """A row is a duplicate unless it has the smallest key of its text."""
    first = {}
    for key, text in rows:
        first[text] = min(key, first.get(text, key))
    return sorted(((key, text, key != first[text]) for key, text in rows), key=str)


@pytest.mark.parametrize("name", REPEATED)
def test_repeated_keys_of_different_texts(spark, name):
    rows = REPEATED[name]
    df = spark.createDataFrame(rows, "id int, text string")
    want, counts = brute_flags(rows), Counter(t for _, t in rows)
    assert sorted((tuple(r) for r in dd.duplicate_flags(df, "id").collect()), key=str) == want
    assert sorted((tuple(r) for r in dd.dedup(df, "id").collect()), key=str) == [r[:2] for r in want if not r[2]]
    repeated = sorted((r for r in rows if counts[r[1]] > 1), key=str)
    assert sorted((tuple(r) for r in dd.duplicate_rows(df, "id").collect()), key=str) == repeated


@pytest.mark.parametrize("operator", [dd.dedup, dd.duplicate_flags, dd.duplicate_rows])
@pytest.mark.parametrize("rows", [SAME_ROW, *REPEATED.values()])
def test_strict_operators_raise_on_repeated_keys(spark, operator, rows):
    df = spark.createDataFrame(rows, "id int, text string")
    first = [r for i, r in enumerate(rows) if r[0] not in [k for k, _ in rows[:i]]]
    if operator is dd.dedup or rows is not REPEATED["key of later copies only"]:
        with pytest.raises(PySparkException, match="repeated"):
            operator(df, "id", strict=True).collect()
    unique = spark.createDataFrame(first, "id int, text string")
    assert sorted(map(str, operator(unique, "id", strict=True).collect())) == sorted(map(str, operator(unique, "id").collect()))


def brute_profile(texts):
    counts = Counter(t for t in texts if t is not None)
    if not counts:
        return (0, 0, None, None)
    most = max(counts.values())
    return (sum(counts.values()), len(counts), min((t for t in counts if counts[t] == most), key=str.encode), most)


HEAD = "x" * pf.HEAD
PROFILES = {
    "all unique": [f"{HEAD}{i}" for i in range(50)] + ["y", HEAD],
    "ties with one beginning": [f"{HEAD}{i % 20}" for i in range(40)] + ["z", "z", "a", f"{HEAD}0a"],
    "ties with several beginnings": ["b", "b", "ü", "ü", "a", "\U0001f600", "\U0001f600", "c"],
    "a third of the rows": ["hot"] * 40 + [f"t{i}" for i in range(80)],
    "empty texts and NULLs": ["", "", None, None, None, "a", "a"],
    "NULLs only": [None, None],
    "none": [],
}


@pytest.mark.parametrize("name", PROFILES)
def test_text_profile_equals_brute_force(spark, name):
    texts = PROFILES[name]
    random.Random(1).shuffle(texts)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [tuple(r) for r in pf.text_profile(df).collect()] == [brute_profile(texts)]


def test_text_profile_groups_no_texts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = pf.text_profile(df)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)?", plan)
    assert keys and not [k for k in keys if "text" in k]
    # the only texts that travel are those that begin like the top one
    assert "left(text" in plan or "substring(text" in plan
