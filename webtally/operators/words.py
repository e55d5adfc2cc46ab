"""Word statistics. Every operator takes the texts as they are; deduplicate first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from webtally.functions.tokens import has_words, raw_terms, tokens, word_count


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of every word: ``corpus, countv``.

    Words are counted per partition before the shuffle, so a word that makes up a
    large part of the corpus still reaches its reducer as one row per task.
    """
    return (
        df.select(F.explode(tokens(text)).alias("corpus"))
        .groupBy("corpus")
        .agg(F.count("*").alias("countv"))
    )


def top_tokens(df: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """The ``n`` most frequent words; equal counts in order of the word."""
    return token_counts(df, text).orderBy(F.desc("countv"), F.asc("corpus")).limit(n)


def top_tokens_first_seen(df: DataFrame, key: str, n: int = 10, text: str = "text") -> DataFrame:
    """The ``n`` most frequent words; of equal counts, the one met first in the corpus.

    Words are ranked by count and first text. Places within a text are looked up only for
    the words that reach the cut, which are ``n`` and those that tie in one text at most.
    """
    counts = (
        df.select(F.col(key).alias("first"), F.explode(tokens(text)).alias("corpus"))
        .groupBy("corpus")
        .agg(F.count("*").alias("countv"), F.min("first").alias("first"))
    )
    # Spark cuts a rank in every partition before the rows of all of them meet.
    place = F.rank().over(Window.partitionBy().orderBy(F.desc("countv"), F.asc("first")))
    reached = counts.withColumn("_rank", place).where(F.col("_rank") <= n).drop("_rank")
    # At most n texts are looked at, so their keys can be broadcast.
    wanted = F.broadcast(reached.select(F.col("first").alias("_key")).distinct())
    words = df.join(wanted, F.col(key) == F.col("_key"), "left_semi").select(
        F.col(key).alias("first"), F.posexplode(tokens(text)).alias("pos", "corpus")
    )
    return (
        words.join(reached, ["first", "corpus"])
        .groupBy("corpus", "countv", "first")
        .agg(F.min("pos").alias("pos"))
        .orderBy(F.desc("countv"), F.asc("first"), F.asc("pos"))
        .limit(n)
        .select("corpus", "countv")
    )


def tokens_head(df: DataFrame, key: str, n: int = 5, text: str = "text") -> DataFrame:
    """The first ``n`` words of the corpus in order of ``key``.

    They lie in the first ``n`` texts that have any word, so only those are split
    into rows.
    """
    words = F.col("_words")
    return (
        df.select(key, text)
        .where(has_words(text))
        .orderBy(key)
        .limit(n)
        .select(key, tokens(text).alias("_words"))
        .select(key, F.posexplode(F.slice(words, 1, n)).alias("pos", "corpus"))
        .orderBy(key, "pos")
        .limit(n)
    )


def word_count_hist(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows per length in words: ``n_words, n_rows``. Null texts are left out."""
    return (
        df.where(F.col(text).isNotNull())
        .select(word_count(text).alias("n_words"))
        .groupBy("n_words")
        .agg(F.count("*").alias("n_rows"))
    )


def labelled_hist(hist: DataFrame) -> DataFrame:
    """The histogram with ``"<n> words:"`` labels, in the order of the labels as text."""
    label = F.concat(F.col("n_words").cast("string"), F.lit(" words:"))
    return hist.select(label.alias("words"), "n_words", "n_rows").orderBy("words")


def word_count_stats(hist: DataFrame) -> DataFrame:
    """Two averages that are easily mixed up.

    ``mean_rows_per_length`` is the mean of the histogram's counts,
    ``avg_words_per_row`` the mean number of words in a row.
    """
    return hist.agg(
        F.avg("n_rows").alias("mean_rows_per_length"),
        (F.sum(F.col("n_words") * F.col("n_rows")) / F.sum("n_rows")).alias("avg_words_per_row"),
    )


def term_weights(
    df: DataFrame, max_words: int = 2000, stop_words: Sequence[str] = (), text: str = "text"
) -> DataFrame:
    """Weights of the most frequent terms, as a word cloud scales them.

    Columns ``term`` (lower case), ``shown`` (its most frequent spelling, the
    smallest of equals), ``n`` and ``weight = n / max n``. A trailing ``'s`` is cut,
    numbers and stop words are dropped, and a plural in ``s`` counts with its
    singular when that occurs. Terms are counted as they stand first; everything
    else works on the vocabulary.
    """
    raw = df.select(F.explode(raw_terms(text)).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    forms = raw.select(F.regexp_replace("raw", "'[sS]$", "").alias("form"), "n").withColumn("lower", F.lower("form"))
    dropped = F.col("form").rlike(r"^\p{Nd}+$")
    if stop_words:
        dropped |= F.col("lower").isin([w.lower() for w in stop_words])

    # A plural and its singular share their base. Without the singular in its group
    # a base stands for the plural alone, so a base is always exactly one term.
    ends_in_s = F.col("lower").endswith("s") & ~F.col("lower").endswith("ss")
    without_last = {c: F.expr(f"left({c}, length({c}) - 1)") for c in ("lower", "form")}
    forms = forms.select(
        "form",
        "lower",
        F.when(ends_in_s, without_last["lower"]).otherwise(F.col("lower")).alias("base"),
        "n",
        dropped.alias("dropped"),
    )
    # Dropped terms go after the window. A filter before it would be pushed below the
    # count and test every occurrence instead of every distinct term.
    is_singular = ~F.col("dropped") & (F.col("lower") == F.col("base"))
    forms = forms.withColumn("has_singular", F.bool_or(is_singular).over(Window.partitionBy("base")))
    is_merged = F.col("has_singular") & (F.col("lower") != F.col("base"))
    merged = forms.where(~F.col("dropped")).select(
        "base",
        F.when(F.col("has_singular"), F.col("base")).otherwise(F.col("lower")).alias("term"),
        F.when(is_merged, without_last["form"]).otherwise(F.col("form")).alias("shown"),
        "n",
    )
    # Grouping by the base first keeps the partitioning of the window.
    spellings = merged.groupBy("base", "term", "shown").agg(F.sum("n").alias("n"))
    terms = spellings.groupBy("base", "term").agg(
        F.min_by("shown", F.struct(-F.col("n"), F.col("shown"))).alias("shown"), F.sum("n").alias("n")
    )
    kept = terms.select("term", "shown", "n").orderBy(F.desc("n"), F.asc("term")).limit(max_words)
    # The window sees the kept rows only, at most max_words of them.
    return kept.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy()))
