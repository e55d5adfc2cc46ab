"""The three analyses of a corpus, each as a set of report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from webtally.functions.normalize import SORANI_ARABIC, Rule, normalize_text
from webtally.operators import dedup as dd, frequency as fq, profile as pf, websites as ws, words as wd
from webtally.plans.materialize import materialize

# Columns beside key and text of what one pass over a corpus keeps.
URL = "_url"
PRESENT = "_present"


def website_report(
    df: DataFrame, rules: DataFrame, url: Column | str, minimum: int = 1000, n_top: int = 15
) -> dict[str, DataFrame]:
    """Where the documents come from. The crawl is read once for all tables but the row count."""
    totals = materialize(ws.website_totals(df, rules, url), "websites")
    freq = totals.where(F.col("website").isNotNull())
    frequent = fq.at_least(freq, minimum)
    return {
        "website_counts": fq.by_frequency(freq, "website"),
        "website_distinct": fq.distinct_values(freq, "n_websites"),
        "website_top": fq.top(freq, "website", n_top),
        "website_reconcile": fq.reconcile(totals, "website", df.agg(F.count("*")).scalar()),
        "website_threshold": fq.by_frequency(frequent, "website"),
        "website_treemap": fq.treemap_nodes(frequent, ["website"]),
    }


def clean_texts(
    df: DataFrame, text: str = "text", rules: Sequence[Rule] = SORANI_ARABIC, null_as: str | None = None
) -> DataFrame:
    """Normalise the text column and make it a string. Runs before any duplicate is looked for."""
    return df.withColumn(text, pf.cast_string(normalize_text(text, rules), null_as))


def marked_texts(df: DataFrame, key: str, text: str, groups: DataFrame) -> DataFrame:
    """The texts with their numbers of copies, written once for duplicates and words: texts are shuffled here only."""
    return materialize(dd.with_copies(df.select(key, text), key, text, groups, strict=True), "marked-texts")


def duplicate_report(
    df: DataFrame,
    key: str,
    text: str = "text",
    n_head: int = 10,
    groups: DataFrame | None = None,
    marked: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Text profile and exact duplicates of cleaned texts."""
    repeated = dd.duplicate_rows(df, key, text, groups) if marked is None else dd.repeated_rows(marked)
    return {
        "text_profile": pf.text_profile_first_seen(df, key, text, groups),
        "duplicate_count": dd.duplicate_count(df, text, groups),
        "duplicate_head": dd.first_in_text_order(repeated, key, n_head, text),
    }


def word_report(
    df: DataFrame,
    key: str,
    text: str = "text",
    max_words: int = 2000,
    n_top: int = 10,
    stop_words: Sequence[str] = (),
    groups: DataFrame | None = None,
    marked: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Word statistics of the distinct texts, which are written once for all tables."""
    groups = materialize(dd.text_groups(df, key, text), "text-groups") if groups is None else groups
    marked = marked_texts(df, key, text, groups) if marked is None else marked
    texts = dd.first_copies(marked)
    hist = materialize(wd.word_count_hist(texts, text), "word-counts")
    return {
        "dedup_count": pf.row_count(texts),
        "term_weights": wd.term_weights(texts, max_words, stop_words, text),
        "tokens_head": wd.tokens_head(texts, key, text=text),
        "top_tokens": wd.top_tokens(texts, n_top, text),
        "word_count_hist": wd.labelled_hist(hist),
        "word_count_stats": wd.word_count_stats(hist),
    }


def corpus_report(
    df: DataFrame,
    rules: DataFrame,
    key: str,
    url: Column | str,
    text: str = "text",
    minimum: int = 1000,
    max_words: int = 2000,
    stop_words: Sequence[str] = (),
    null_as: str | None = None,
    buckets: int | None = None,
    n_head: int = 5,
) -> dict[str, DataFrame]:
    """All report tables of a corpus.

    The corpus is read once, for a table of keys, URLs, cleaned texts and which columns have values.
    All else comes from that table, of which every analysis reads the columns it needs; the
    preview looks its few keys up in the corpus. Texts are grouped and then profiled; words are
    counted over the distinct ones. With ``buckets`` that table is
    written by key in so many, so that marking copies moves no text again. Call it and write the
    tables within :func:`webtally.plans.materialize.scratch` to have what they share dropped.
    """
    raw_url = F.col(url) if isinstance(url, str) else url
    own = df.select(key, text, raw_url.alias(URL), pf.presence(df).alias(PRESENT))
    passed = clean_texts(own, text, null_as=null_as)
    kept = materialize(passed, "clean-texts", bucket_by=None if buckets is None else key, buckets=buckets)
    cleaned = kept.select(key, text)
    groups = materialize(dd.text_groups(cleaned, key, text), "text-groups")
    marked = marked_texts(cleaned, key, text, groups)
    return {
        "corpus_count": pf.row_count(kept),
        "corpus_head": preview(df, kept.select(key), key, n_head),
        "meta_head": pf.head(kept.select(key, F.col(URL).alias("url")), key, n_head),
        "table_profile": pf.table_profile_from(kept, PRESENT, df.dtypes),
        "clean_profile": pf.table_profile(cleaned),
        **website_report(kept, rules, URL, minimum),
        **duplicate_report(cleaned, key, text, groups=groups, marked=marked),
        **word_report(cleaned, key, text, max_words, stop_words=stop_words, groups=groups, marked=marked),
    }


def preview(df: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of ``df``, whose ``keys`` are known from a table that is cheap to read.

    Keys are looked up as constants, by which Parquet skips the row groups without them. Keys made
    while reading, such as places in files, cannot be looked up.
    """
    if isinstance(keys.schema[key].dataType, T.StructType):
        return pf.head(df, key, n)
    first = [row[0] for row in pf.head(keys, key, n).collect()]
    return pf.head(df.where(F.col(key).isin(first)), key, n)
