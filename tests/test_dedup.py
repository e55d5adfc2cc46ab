import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webtally.operators import dedup as dd, profile as pf

NULLS_AND_TIES = [(1, "a"), (2, None), (3, None), (4, "a"), (5, "b")]


def _frame(spark, rows, schema="id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_nulls_are_copies_of_each_other(spark):
    df = _frame(spark, NULLS_AND_TIES)
    assert sorted(r.id for r in dd.dedup(df, "id").collect()) == [1, 2, 5]
    flags = {r.id: r.is_duplicate for r in dd.duplicate_flags(df, "id").collect()}
    assert flags == {1: False, 2: False, 3: True, 4: True, 5: False}
    assert sorted(r.id for r in dd.duplicate_rows(df, "id").collect()) == [1, 2, 3, 4]
    assert tuple(dd.duplicate_count(df).first()) == (5, 3, 2)
    assert dd.dedup_count(df).first().n_rows == 3


def test_empty_input(spark):
    df = _frame(spark, [])
    assert dd.dedup(df, "id").count() == 0
    assert tuple(dd.duplicate_count(df).first()) == (0, 0, 0)


def test_column_order_and_names_are_kept(spark):
    df = _frame(spark, [("x", "a", 1), ("y", "a", 2)], "`o.dd` string, text string, id long")
    assert [tuple(r) for r in dd.dedup(df, "id").collect()] == [("x", "a", 1)]
    assert dd.duplicate_rows(df, "id").columns == df.columns
    assert dd.duplicate_flags(df, "id").columns == [*df.columns, "is_duplicate"]


@pytest.fixture(scope="module")
def mixed():
    """Random rows, a third of which hold one text, in shuffled order."""
    rng = random.Random(3)
    texts = ["copied everywhere"] * 1000 + [rng.choice("abcdefgh") * rng.randrange(1, 40) for _ in range(1500)]
    texts += [None] * 20 + [""] * 10 + [f"only {i}" for i in range(470)]
    rng.shuffle(texts)
    return pd.DataFrame({"id": range(len(texts)), "text": texts, "lang": [rng.choice("xyz") for _ in texts]})


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_pandas(spark, mixed, partitions):
    rows = [tuple(None if v is None else v for v in r) for r in mixed.itertuples(index=False)]
    df = _frame(spark, rows, "id long, text string, lang string").repartition(partitions, F.xxhash64("id"))
    duplicated = mixed.text.duplicated()

    flags = {r.id: r.is_duplicate for r in dd.duplicate_flags(df, "id").collect()}
    assert flags == dict(zip(mixed.id, duplicated))

    kept = mixed[~duplicated]
    want = set(kept[["id", "text", "lang"]].itertuples(index=False, name=None))
    full = dd.dedup(df, "id")
    assert full.columns == df.columns
    assert {tuple(r) for r in full.collect()} == want
    by_string = df.withColumn("id", F.format_string("%05d", "id"))
    assert {int(r.id) for r in dd.dedup(by_string, "id").collect()} == set(kept.id)
    assert {int(r.id) for r in dd.duplicate_rows(by_string, "id").collect()} == set(
        mixed.id[mixed.text.duplicated(keep=False)]
    )

    repeated = mixed[mixed.text.isin(mixed.text[duplicated])]
    assert {r.id for r in dd.duplicate_rows(df, "id").collect()} == set(repeated.id)
    first = dd.first_in_text_order(dd.duplicate_rows(df, "id"), "id", 100).collect()
    want_order = sorted(repeated.itertuples(), key=lambda r: (r.text is not None, r.text or "", r.id))
    assert [r.id for r in first] == [r.id for r in want_order[:100]]

    counts = dd.duplicate_count(df).first()
    assert counts.n_rows - counts.n_duplicates == full.count() == dd.dedup_count(df).first().n_rows


def test_shared_groups_change_nothing(spark):
    df = _frame(spark, NULLS_AND_TIES)
    groups = dd.text_groups(df, "id", "text")
    for operator in (dd.dedup, dd.duplicate_rows, dd.duplicate_flags, pf.text_profile_first_seen):
        assert {tuple(r) for r in operator(df, "id", groups=groups).collect()} == {
            tuple(r) for r in operator(df, "id").collect()
        }
    assert dd.duplicate_count(df, groups=groups).first() == dd.duplicate_count(df).first()


def test_dedup_is_idempotent(spark, mixed):
    df = _frame(spark, list(zip(mixed.id.tolist(), (None if pd.isna(t) else t for t in mixed.text))))
    once = dd.dedup(df, "id")
    assert dd.dedup(once, "id").exceptAll(once).count() == 0
    assert dd.duplicate_count(once).first().n_duplicates == 0


def _largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_copies_of_one_text_stay_spread(spark):
    """With half of all rows holding one text, no partition gets more than its part of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        other = F.sha2(F.col("id").cast("string"), 256)
        text = F.when(F.col("id") % 2 == 0, "hot").otherwise(other)
        df = spark.range(0, 40000, 1, 8).select("id", text.alias("text"))
        assert dd.duplicate_rows(df, "id").count() == 20000
        assert _largest_share(dd.duplicate_rows(df, "id")) < 0.2
        assert _largest_share(dd.duplicate_flags(df, "id")) < 0.2
        assert _largest_share(dd.dedup(df, "id")) < 0.2
        assert dd.dedup(df, "id").count() == 20001
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_and_repeated_keys_fail_instead_of_losing_rows(spark):
    from webtally.plans.reports import word_report

    nulls = spark.createDataFrame([(None, "a"), (2, "b")], "id bigint, text string")
    with pytest.raises(Exception, match="NULL in the key column"):
        dd.dedup(nulls, "id").collect()
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c")], "id bigint, text string")
    with pytest.raises(Exception, match="are repeated"):
        word_report(repeated, "id")["dedup_count"].collect()
    strings = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "c")], "id string, text string")
    assert word_report(strings, "id")["dedup_count"].first()["n_rows"] == 2
