"""Websites of a crawl: registered domains from URLs and a public-suffix table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from webtally.functions.urls import host_of, website_of
from webtally.operators.frequency import reconcile

# A rule table within both bounds is broadcast. The full published list has
# about ten thousand rules and 200 kB; both are measured before the hint is given.
MAX_BROADCAST_RULES = 200_000
MAX_BROADCAST_BYTES = 8 << 20


def _one_row_per_rule(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule").agg(
        F.bool_or(F.col("kind") == "std").alias("std"),
        F.bool_or(F.col("kind") == "wild").alias("wild"),
        F.bool_or(F.col("kind") == "exc").alias("exc"),
    )


def _count_labels(name: Column) -> Column:
    return F.array_size(F.split(name, r"\."))


def heavy_candidates(df: DataFrame, host: str, depth: int, parts: int) -> DataFrame:
    """``candidate, copies``: suffixes of up to ``depth`` labels that more than one in ``parts`` rows of ``df`` end in.

    ``copies`` is how many of the ``parts`` shares of the rows each has. Every depth has fewer than
    ``parts`` such suffixes, and fewer than twice as many copies of all of them.
    """
    hosts = df.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    depths = F.sequence(F.lit(1), F.least(F.array_size(labels), F.lit(depth)))
    suffixes = F.transform(depths, lambda d: F.array_join(F.slice(labels, -d, d), "."))
    counted = hosts.select(F.explode(suffixes).alias("candidate"), "n").groupBy("candidate").agg(F.sum("n").alias("n"))
    shares = F.col("n") * parts / df.agg(F.count("*")).scalar()
    return counted.where(shares > 1).select("candidate", F.ceil(shares).cast("int").alias("copies"))


def copied_rules(rules: DataFrame, heavy: DataFrame) -> DataFrame:
    """Each rule with a ``salt``: 0, or for one under a heavy candidate as many as that has copies."""
    marked = rules.join(F.broadcast(heavy), F.col("rule") == F.col("candidate"), "left")
    copies = F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)
    return marked.select(*rules.columns, F.explode(copies).alias("salt"))


def with_website(
    df: DataFrame,
    rules: DataFrame,
    host: str = "host",
    website: str = "website",
    tidy: bool = False,
    salt_by: Sequence[str] | None = None,
    max_broadcast_rules: int = MAX_BROADCAST_RULES,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add the registered domain of ``host`` after the public-suffix algorithm.

    The candidate suffixes of a host are its last 1, 2, ... labels. Each depth is
    one equality join with the rules of that many labels, so rows are neither
    multiplied nor regrouped, and with broadcast rules nothing is shuffled. A rule
    table above the size bounds is joined by shuffle instead, on the candidate and a salt
    taken from ``salt_by`` (all columns by default). Rows of a candidate that would fill more than a
    shuffle partition have as many salts as they would fill, and the rule of that candidate as many
    copies; other rules are in one place. Rows without a candidate spread over all tasks.
    The heavy candidates are counted first, in a pass over the hosts; they are fewer than the
    partitions times the depth of the rules, so they are broadcast.
    """
    size = rules.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.max(_count_labels(F.col("rule"))), F.lit(0)).alias("depth"),
    ).first()
    table = _one_row_per_rule(rules)
    small = size["n"] <= max_broadcast_rules and size["n_bytes"] <= max_broadcast_bytes

    n_labels = _count_labels(F.col(host))
    joined = df
    if not small:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        heavy = df.sparkSession.createDataFrame(heavy_candidates(df, host, size["depth"], parts).toArrow())
        spread = F.xxhash64(*(salt_by or [f"`{c}`" for c in df.columns]))
        joined = df.withColumn("_spread", spread)
    lengths, exceptions = [F.lit(0), F.lit(0)], []
    for depth in range(1, size["depth"] + 1):
        prefix = f"_rule{depth}_"
        side = table.where(_count_labels(F.col("rule")) == depth)
        candidate = F.when(n_labels >= depth, F.substring_index(F.col(host), ".", -depth))
        if small:
            side = F.broadcast(side.select(*[F.col(c).alias(prefix + c) for c in side.columns]))
            condition = candidate == F.col(prefix + "rule")
        else:
            own = heavy.where(_count_labels(F.col("candidate")) == depth)
            side = copied_rules(side, own)
            side = side.select(*[F.col(c).alias(prefix + c) for c in side.columns])
            own = own.select(F.col("candidate").alias(prefix + "heavy"), F.col("copies").alias(prefix + "copies"))
            joined = joined.join(F.broadcast(own), candidate == F.col(prefix + "heavy"), "left")
            salts = F.when(candidate.isNull(), parts).otherwise(F.coalesce(prefix + "copies", F.lit(1)))
            joined = joined.withColumn(prefix + "own", F.pmod("_spread", salts).cast("int"))
            # no rule is empty, so a row without a candidate meets none
            condition = F.coalesce(candidate, F.lit("")) == F.col(prefix + "rule")
            condition &= F.col(prefix + "own") == F.col(prefix + "salt")
        joined = joined.join(side, condition, "left")
        lengths.append(F.when(F.col(prefix + "std"), depth))
        lengths.append(F.when(F.col(prefix + "wild") & (n_labels > depth), depth + 1))
        exceptions.append(F.when(F.col(prefix + "exc"), depth - 1))

    longest = F.greatest(*lengths)
    # An exception takes precedence; of several, the one with the most labels.
    suffix_length = F.coalesce(*reversed(exceptions), longest) if exceptions else longest
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns if c != website],
        website_of(F.col(host), suffix_length, tidy).alias(website),
    )


def page_websites(df: DataFrame, rules: DataFrame, key: str, url: Column | str, **options) -> DataFrame:
    """Key and website of every page."""
    hosts = df.select(key, host_of(url).alias("host"))
    return with_website(hosts, rules, salt_by=[key], **options).select(key, "website")


def host_counts(df: DataFrame, url: Column | str) -> DataFrame:
    """Pages per host, with a null group for pages without one."""
    return df.select(host_of(url).alias("host")).groupBy("host").agg(F.count("*").alias("counts"))


def website_totals(df: DataFrame, rules: DataFrame, url: Column | str, **options) -> DataFrame:
    """Pages per website, the null group kept.

    Pages are first counted by host. Domains are then worked out once per host,
    and only host totals reach the second aggregate, however many pages one site has.
    """
    sites = with_website(host_counts(df, url), rules, salt_by=["host"], **options)
    return sites.groupBy("website").agg(F.sum("counts").alias("counts"))


def website_counts(df: DataFrame, rules: DataFrame, url: Column | str, **options) -> DataFrame:
    """Frequency table ``website, counts``."""
    return website_totals(df, rules, url, **options).where(F.col("website").isNotNull())


def reconcile_websites(
    df: DataFrame, rules: DataFrame, url: Column | str, expected: int | None = None, **options
) -> DataFrame:
    """Check that the website counts add up to the rows of the source, or to ``expected``."""
    total = df.agg(F.count("*")).scalar() if expected is None else F.lit(expected)
    return reconcile(website_totals(df, rules, url, **options), "website", total)
