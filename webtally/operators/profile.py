"""Shape and content of a table: size, preview, completeness, text profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webtally.functions.digest import text_digest
from webtally.operators.dedup import DIGEST, text_groups


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in order of ``key``."""
    return df.orderBy(key).limit(n)


def flatten_struct(df: DataFrame, path: str, *keep: str) -> DataFrame:
    """Fields of a (nested) struct as columns, after the columns to keep."""
    return df.select(*keep, f"{path}.*")


def cast_string(column: Column | str, null_as: str | None = None) -> Column:
    """A value as string. NULL stays NULL unless ``null_as`` names a text for it."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return text if null_as is None else F.coalesce(text, F.lit(null_as))


def _profile_rows(counts: DataFrame, dtypes: list[tuple[str, str]]) -> DataFrame:
    """One row per column from one row with their counts ``n0, n1, ...``."""
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), F.lit(dtype).alias("dtype")
        )
        for i, (c, dtype) in enumerate(dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def table_profile(df: DataFrame) -> DataFrame:
    """Position, name, non-null count and type of every column, from one aggregate."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, (c, _) in enumerate(df.dtypes)])
    return _profile_rows(counts, df.dtypes)


def presence(df: DataFrame) -> Column:
    """Which columns of a row have a value, in their order: what a pass over the rows keeps for their profile."""
    return F.array(*[F.col(f"`{c}`").isNotNull() for c in df.columns])


def table_profile_from(kept: DataFrame, mask: str, dtypes: list[tuple[str, str]]) -> DataFrame:
    """:func:`table_profile` of a table with these types, of which ``kept`` has the :func:`presence` of every row."""
    counts = kept.agg(*[F.count_if(F.get(mask, F.lit(i))).alias(f"n{i}") for i in range(len(dtypes))])
    return _profile_rows(counts, dtypes)


def _totals() -> list[Column]:
    """Totals over one row per distinct text with its number of ``copies``."""
    return [
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("count"),
        F.count("*").alias("unique"),
        F.max("copies").alias("freq"),
    ]


# Characters of a text that travel with its digest.
HEAD = 32


def text_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Count, distinct count, most frequent text and its frequency.

    Of equally frequent texts the smallest is ``top``. Texts are grouped by digest, and with a digest goes the
    beginning of its text, of :data:`HEAD` characters. The most frequent digests have a smallest beginning;
    only texts that begin like that are looked at again, matched by digest with those among
    the most frequent, and the smallest of them is found by a plain minimum.
    """
    known = df.where(F.col(text).isNotNull())
    head = F.left(F.col(text), F.lit(HEAD))
    groups = known.groupBy(text_digest(text).alias(DIGEST)).agg(F.count("*").alias("copies"), F.min(head).alias("head"))
    best = groups.agg(*_totals(), F.min_by("head", F.struct(-F.col("copies"), F.col("head"))).alias("head"))
    freq, first = best.select("freq").scalar(), best.select("head").scalar()
    reached = groups.where((F.col("copies") == freq) & (F.col("head") == first)).select(DIGEST)
    like_it = known.where(head == first).select(text_digest(text).alias(DIGEST), F.col(text).alias("_text"))
    top = like_it.join(reached, DIGEST, "left_semi").agg(F.min("_text")).scalar()
    return best.select("count", "unique", top.alias("top"), "freq")


def text_profile_first_seen(
    df: DataFrame, key: str, text: str = "text", groups: DataFrame | None = None
) -> DataFrame:
    """The same profile, with the text met first in order of ``key`` as ``top`` of equals.

    Texts are grouped by digest. Only the key of the top text leaves the groups, as
    the additional column ``top_key``, and its row is looked up by that key.
    """
    known = (text_groups(df, key, text) if groups is None else groups).where(F.col(DIGEST).isNotNull())
    summary = known.agg(*_totals(), F.min_by(key, F.struct(-F.col("copies"), F.col(key))).alias("top_key"))
    top = df.where(F.col(key) == summary.select("top_key").scalar()).select(text).scalar()
    return summary.select("count", "unique", top.alias("top"), "freq", "top_key")
