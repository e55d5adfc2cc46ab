"""Exact duplicates by text.

``key`` names a unique, non-null, orderable column; NULL keys raise. A key that is repeated with another
text is right all the same: a row is a first copy if both its key and its digest are those of
its text's group. Rows that repeat key and text cannot be told apart, and ``strict`` operators
raise on any repeated key, at the price of one more shuffle of keys. The row with the smallest key is the first of its copies. Null texts count as copies of each other.

Texts are grouped by digest, in rows of a digest and a key that are combined within
each input partition before they are shuffled. Whole rows are then matched with the
resulting keys. The key is unique, so a text that fills a third of all rows is
spread like any other, and no task gathers its copies.

Several operators on the same rows can share the ``groups`` of :func:`text_groups`,
written once, so that the texts are read for their digests a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webtally.functions.digest import text_digest

DIGEST = "_digest"
COPIES = "_n_copies"


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in df.columns]


def text_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """One narrow row per distinct text: number of copies and first key. A NULL key fails the job."""
    return df.groupBy(text_digest(text).alias(DIGEST)).agg(
        F.count("*").alias("copies"), F.min(_present(key)).alias(key)
    )


def checked_keys(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys; a key of several rows fails the job, whatever its rows hold. Only keys are shuffled."""
    rows = df.groupBy(key).agg(F.count("*").alias("_rows"))
    message = F.concat(F.lit(f"Values of the key column {key} are repeated: "), F.col(key).cast("string"))
    return rows.select(F.when(F.col("_rows") == 1, F.col(key)).otherwise(F.raise_error(message)).alias(key))


def _present(key: str) -> Column:
    """The key; without one a row could be neither kept nor dropped, and would be lost silently."""
    missing = F.raise_error(F.lit(f"NULL in the key column {key}: rows without a key cannot be deduplicated"))
    return F.when(F.col(key).isNotNull(), F.col(key)).otherwise(missing)


def with_copies(
    df: DataFrame,
    key: str,
    text: str = "text",
    groups: DataFrame | None = None,
    copies: str = COPIES,
    strict: bool = False,
) -> DataFrame:
    """Every row with the number of copies of its text if it is the first of them, NULL if it is a later one.

    One match by key, of which the other operators are filters: written once, it
    serves all of them. Rows are dealt by the key alone, and the digests compared where keys meet, so a row is matched
    once at most. Only the columns of ``df`` that are used later are shuffled, and a digest. The join is
    Spark's to choose; with ``spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold`` set, as
    in ``session``, it hashes partitions with few keys and sorts, and spills, the others.
    """
    groups = text_groups(df, key, text) if groups is None else groups
    if strict:
        groups = groups.join(checked_keys(df, key), key)
    none = F.lit(b"")
    first = groups.select(F.col(key), F.coalesce(DIGEST, none).alias("_first"), F.col("copies").alias("_copies"))
    own = F.coalesce(text_digest(text), none).alias("_own")
    # not as an equality, by which rows would be dealt as well
    same = (F.col("_own") <= F.col("_first")) & (F.col("_own") >= F.col("_first"))
    left, right = df.select(*_columns(df), own).alias("_l"), first.alias("_r")
    joined = left.join(right, (F.col(f"_l.`{key}`") == F.col(f"_r.`{key}`")) & same, "left")
    return joined.select(*[F.col(f"_l.`{name}`") for name in df.columns], F.col("_copies").alias(copies))


def first_copies(marked: DataFrame, copies: str = COPIES) -> DataFrame:
    """The first row of every distinct text, from rows marked by :func:`with_copies`."""
    return marked.where(F.col(copies).isNotNull()).drop(copies)


def repeated_rows(marked: DataFrame, copies: str = COPIES) -> DataFrame:
    """The rows whose text occurs more than once, from rows marked by :func:`with_copies`."""
    return marked.where(F.coalesce(F.col(copies) > 1, F.lit(True))).drop(copies)


def dedup(
    df: DataFrame, key: str, text: str = "text", groups: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Keep the first row of every distinct text. A text is shuffled once."""
    return first_copies(with_copies(df, key, text, groups, strict=strict))


def duplicate_flags(
    df: DataFrame,
    key: str,
    text: str = "text",
    flag: str = "is_duplicate",
    groups: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Mark every row but the first of its text. The text is not shuffled unless the caller selects it."""
    marked = with_copies(df, key, text, groups, strict=strict)
    return marked.select(*_columns(df), F.col(COPIES).isNull().alias(flag))


def duplicate_count(df: DataFrame, text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """Rows, distinct texts and the rows in excess of them; only digests are shuffled."""
    if groups is None:
        groups = df.groupBy(text_digest(text).alias(DIGEST)).agg(F.count("*").alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count("*").alias("n_distinct"),
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def dedup_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that :func:`dedup` keeps, without building them."""
    return duplicate_count(df, text).select(F.col("n_distinct").alias("n_rows"))


def duplicate_rows(
    df: DataFrame, key: str, text: str = "text", groups: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """All rows whose text occurs more than once, first copies included.

    Rows are matched by key. A join with the repeated digests would gather the copies of a text.
    """
    return repeated_rows(with_copies(df, key, text, groups, strict=strict))


def first_in_text_order(df: DataFrame, key: str, n: int, text: str = "text") -> DataFrame:
    """The ``n`` first rows by text and then by key.

    A top-k, not a sort: sorting everything by text would make Spark sample whole
    texts to the driver to find the ranges.
    """
    return df.orderBy(text, key).limit(n)
