
from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from webtally.functions import host_name, normalize_text, unify_numerals
from webtally.operators import dedup as dd, frequency as fq, profile as pf, websites as ws, words as wd
from webtally.plans.materialize import materialize
from webtally.plans.reports import clean_texts
from webtally.sources import read_corpus, suffix_rules, with_input_order

FLAGSHIP_DIR = "/root/testdata/sf0.001"

# The fixture hosts end in three suffixes. The second list adds a wildcard rule and
# its exception, for the URLs rewritten by _rewritten_pages.
FIXTURE_RULES = ("com", "net", "org")
REWRITTEN_RULES = ("com", "jp", "co.jp", "*.kawasaki.jp", "!city.kawasaki.jp")

# Thresholds that keep some websites and drop others at sf0.01.
MIN_WEBSITE_PAGES = 60
MIN_HOST_PAGES = 10

# Standard error of a sketch of the usual size.
SKETCH_ERROR = 1.04 / 2 ** (fq.SKETCH_BITS / 2)

STOP_WORDS = ("the", "de", "la")

# The fixtures have no Arabic script. These one-to-one maps derive some from their
# own texts: letters the normalisation rules treat, a joiner, and both digit sets.
LATIN_LETTERS = "kyihrzt0123456789"
ARABIC_LETTERS = "كيىهر" + "\N{ZERO WIDTH NON-JOINER}" + "\N{ARABIC TATWEEL}" + "٠١٢٣٤۵۶۷۸۹"


def _documents(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return read_corpus(spark, f"{sf_dir}/documents.parquet", **options)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "text")


def _distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup(_texts(spark, sf_dir), "doc_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their URL where crawl metadata has it, in a field of a nested struct."""
    headers = F.struct(F.col("url").alias("warc-target-uri"))
    return read_corpus(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", F.struct(headers.alias("warc_headers")).alias("meta")
    )


URL = "meta.warc_headers.`warc-target-uri`"


def _rewritten_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose domains are moved under suffixes with several labels."""
    url = F.col(URL)
    for old, new in (
        ("example.com", "example.co.jp"),
        ("example.net", "example.kawasaki.jp"),
        ("example.org", "city.kawasaki.jp"),
    ):
        url = F.replace(url, F.lit(old), F.lit(new))
    return _pages(spark, sf_dir).select("page_id", url.alias("url"))


def _rules(spark: SparkSession) -> DataFrame:
    return suffix_rules(spark, FIXTURE_RULES)


def _websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.website_counts(_pages(spark, sf_dir), _rules(spark), URL)


def _arabic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "text").withColumn("text", F.translate("text", LATIN_LETTERS, ARABIC_LETTERS))


def entry(spark: SparkSession) -> DataFrame:
    """Ten most frequent words of the distinct documents."""
    return wd.top_tokens(_distinct_texts(spark, FLAGSHIP_DIR), 10)


# ---------------------------------------------------------------- corpus access


def corpus_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, lang="fr")


def corpus_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.row_count(_documents(spark, sf_dir))


def corpus_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.head(_documents(spark, sf_dir), "doc_id", 5)


def meta_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.flatten_struct(_pages(spark, sf_dir), "meta.warc_headers", "page_id")


def meta_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.head(meta_flatten(spark, sf_dir), "page_id", 5)


# ---------------------------------------------------------------- websites


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", host_name(URL).alias("host"))


def page_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.page_websites(_pages(spark, sf_dir), _rules(spark), "page_id", URL)


def page_website_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.page_websites(
        _rewritten_pages(spark, sf_dir), suffix_rules(spark, REWRITTEN_RULES), "page_id", "url"
    )


def website_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.by_frequency(_websites(spark, sf_dir), "website")


def website_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.distinct_values(_websites(spark, sf_dir), "n_websites")


def website_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.top(_websites(spark, sf_dir), "website", 15)


def website_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.by_frequency(fq.at_least(_websites(spark, sf_dir), MIN_WEBSITE_PAGES), "website")


def website_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.reconcile_websites(_pages(spark, sf_dir), _rules(spark), URL)


def website_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.treemap_nodes(fq.at_least(_websites(spark, sf_dir), MIN_WEBSITE_PAGES), ["website"])


def website_reconcile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages have no URL, so the counts of websites do not reach the number of pages."""
    url = F.when(F.col("page_id") % 7 != 0, F.col(URL)).alias("url")
    return ws.reconcile_websites(_pages(spark, sf_dir).select("page_id", url), _rules(spark), "url")


def treemap_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the suffixes and, below them, of their websites."""
    suffix = F.substring_index("website", ".", -1).alias("suffix")
    return fq.treemap_nodes(_websites(spark, sf_dir).select(suffix, "website", "counts"), ["suffix", "website"])


def host_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _pages(spark, sf_dir).select(host_name(URL).alias("host"))
    return fq.by_frequency(fq.at_least(fq.value_counts(hosts, "host"), MIN_HOST_PAGES), "host")


# ---------------------------------------------------------------- cleaning


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arabic_texts(spark, sf_dir).select("doc_id", normalize_text("text").alias("text"))


def numeral_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arabic_texts(spark, sf_dir).select("doc_id", unify_numerals("text").alias("text"))


def cast_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_only = F.when(F.col("n_chars") >= 1000, F.col("n_chars"))
    return _documents(spark, sf_dir).select(
        "doc_id",
        pf.cast_string("n_chars").alias("n_chars"),
        pf.cast_string(long_only).alias("long_or_null"),
        pf.cast_string(long_only, null_as="None").alias("long_or_none"),
    )


def normalized_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written first: deduplication reads its input twice, and normalising is the dear part.
    return dd.dedup(materialize(clean_texts(_arabic_texts(spark, sf_dir)), "clean-texts"), "doc_id")


# ---------------------------------------------------------------- profiles and duplicates


def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.text_profile(_texts(spark, sf_dir))


def text_profile_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.text_profile_first_seen(_texts(spark, sf_dir), "doc_id")


def distinct_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts per language and of all, from sketches stored per language and source as of several crawls."""
    docs = _documents(spark, sf_dir)
    sketches = materialize(fq.distinct_sketches(docs, "text", ["lang", "source"]), "sketches")
    merged = fq.merge_sketches(sketches, ["lang"]).unionByName(fq.merge_sketches(sketches, []), allowMissingColumns=True)
    exact = docs.rollup("lang").agg(F.count_distinct("text").alias("n_exact"))
    estimated = fq.sketched_distinct(merged).withColumnRenamed("lang", "of")
    both = exact.join(estimated, exact["lang"].eqNullSafe(estimated["of"]))
    error = F.abs(F.col("n_distinct") - F.col("n_exact")) / F.col("n_exact")
    return both.select("lang", "n_exact", (error <= 4 * SKETCH_ERROR).alias("within"))


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.table_profile(_documents(spark, sf_dir))


def duplicate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.duplicate_flags(_texts(spark, sf_dir), "doc_id").select("doc_id", "is_duplicate")


def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.duplicate_count(_texts(spark, sf_dir))


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.duplicate_rows(_documents(spark, sf_dir), "doc_id")


def duplicate_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.first_in_text_order(duplicate_rows(spark, sf_dir), "doc_id", 10)


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup(_documents(spark, sf_dir), "doc_id")


def dedup_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copies in order of the files, without a key column in the table."""
    texts = with_input_order(_documents(spark, sf_dir).drop("doc_id"))
    return dd.dedup(texts, "input_order").drop("input_order")


def dedup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup_count(_texts(spark, sf_dir))


# ---------------------------------------------------------------- words


def tokens_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.tokens_head(_distinct_texts(spark, sf_dir), "doc_id", 5)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.token_counts(_distinct_texts(spark, sf_dir))


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.top_tokens(_distinct_texts(spark, sf_dir), 10)


def top_tokens_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.top_tokens_first_seen(_distinct_texts(spark, sf_dir), "doc_id", 10)


def word_count_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.labelled_hist(wd.word_count_hist(_distinct_texts(spark, sf_dir)))


def word_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.word_count_stats(wd.word_count_hist(_distinct_texts(spark, sf_dir)))


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.term_weights(_distinct_texts(spark, sf_dir), 2000, STOP_WORDS)


# The training-data operators live in a subpackage of their own. It, or a module that it needs, may be absent.
TRAINING_DATA_QUERIES, TRAINING_DATA_SQL = {}, {}
try:
    from webtally.llm import queries as training_data

    TRAINING_DATA_QUERIES, TRAINING_DATA_SQL = training_data.queries(), training_data.ORACLE_SQL
    import corpus_pipeline

    TRAINING_DATA_QUERIES = TRAINING_DATA_QUERIES | {"pipeline": corpus_pipeline.run}
except ModuleNotFoundError as missing:
    warnings.warn(f"queries for training data are left out: no module {missing.name}", stacklevel=1)

QUERIES = (
    corpus_select, corpus_count, corpus_head, meta_flatten, meta_head,
    url_host, page_website, page_website_wildcard,
    website_counts, website_distinct, website_top, website_threshold, website_reconcile, website_treemap,
    website_reconcile_nulls, treemap_levels, host_threshold,
    text_normalize, numeral_unify, cast_string, normalized_dedup,
    text_profile, text_profile_first_seen, distinct_sketch, table_profile,
    duplicate_flag, duplicate_count, duplicate_rows, duplicate_head, dedup, dedup_input_order, dedup_count,
    tokens_head, token_counts, top_tokens, top_tokens_first_seen,
    word_count_hist, word_count_stats, term_weights,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator: (spark, sf_dir) -> DataFrame over the whole tables."""
    return {query.__name__: query for query in QUERIES} | TRAINING_DATA_QUERIES


# ---------------------------------------------------------------- SQL counterparts

# First row of every distinct text.
SQL_DISTINCT = """distinct_texts AS (
    SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text
)"""

SQL_TOKENS = SQL_DISTINCT + r""", tokens AS (
    SELECT unnest(regexp_extract_all(text, '\S+')) AS corpus FROM distinct_texts
)"""

SQL_LENGTHS = SQL_DISTINCT + r""", lengths AS (
    SELECT n_words, count(*) AS n_rows
    FROM (SELECT len(regexp_extract_all(text, '\S+'))::INTEGER AS n_words FROM distinct_texts)
    GROUP BY n_words
)"""

# All fixture suffixes have one label, so a website is the last two labels of a host.
SQL_WEBSITES = r"""page_websites AS (
    SELECT page_id, parts[-2] || '.' || parts[-1] AS website
    FROM (
        SELECT page_id, string_split(split_part(split_part(lower(url), '://', 2), '/', 1), '.') AS parts
        FROM pages
    )
), websites AS (
    SELECT website, count(*) AS counts FROM page_websites GROUP BY website
)"""

SQL_ARABIC = f"translate(text, '{LATIN_LETTERS}', '{ARABIC_LETTERS}')"

# RE2 has no look-behind: the character before the letter is captured and put back.
SQL_NORMALIZED = rf"""translate(
    regexp_replace(
        regexp_replace(
            replace(replace(
                translate({SQL_ARABIC}, 'كيى', 'کیی'),
                'ه' || chr(8204), 'ە'), chr(1600), ''),
            '(^|[^\p{{L}}\p{{M}}\p{{N}}])ر', '\1ڕ', 'g'),
        '  +', ' ', 'g'),
    '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same columns and rows as the query of the same name."""
    return TRAINING_DATA_SQL | {
        "corpus_select": "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE lang = 'fr'",
        "corpus_count": "SELECT count(*) AS n_rows FROM documents",
        "corpus_head": "SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5",
        "meta_flatten": 'SELECT page_id, url AS "warc-target-uri" FROM pages',
        "meta_head": 'SELECT page_id, url AS "warc-target-uri" FROM pages ORDER BY page_id LIMIT 5',
        "url_host": r"""
            SELECT page_id, nullif(regexp_extract(lower(url), '://([\w\-.]+)', 1), '') AS host FROM pages""",
        "page_website": f"WITH {SQL_WEBSITES} SELECT page_id, website FROM page_websites",
        # net pages sit under a wildcard rule, org pages under its exception, com pages under co.jp
        "page_website_wildcard": r"""
            SELECT page_id,
                   CASE
                       WHEN host LIKE '%example.com' THEN 'example.co.jp'
                       WHEN host LIKE '%example.org' THEN 'city.kawasaki.jp'
                       ELSE coalesce(string_split(host, '.')[-3], '') || '.example.kawasaki.jp'
                   END AS website
            FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)""",
        "website_counts": f"""
            WITH {SQL_WEBSITES} SELECT website, counts FROM websites ORDER BY counts DESC, website""",
        "website_distinct": f"WITH {SQL_WEBSITES} SELECT count(DISTINCT website) AS n_websites FROM page_websites",
        "website_top": f"""
            WITH {SQL_WEBSITES} SELECT website, counts FROM websites ORDER BY counts DESC, website LIMIT 15""",
        "website_threshold": f"""
            WITH {SQL_WEBSITES} SELECT website, counts FROM websites
            WHERE counts >= {MIN_WEBSITE_PAGES} ORDER BY counts DESC, website""",
        "website_reconcile": f"""
            WITH {SQL_WEBSITES}, totals AS (
                SELECT CAST(sum(CASE WHEN website IS NOT NULL THEN counts ELSE 0 END) AS BIGINT) AS total,
                       CAST(sum(CASE WHEN website IS NULL THEN counts ELSE 0 END) AS BIGINT) AS null_rows
                FROM websites
            )
            SELECT total, (SELECT count(*) FROM pages) AS expected, null_rows,
                   total = (SELECT count(*) FROM pages) AS ok
            FROM totals""",
        "website_treemap": f"""
            WITH {SQL_WEBSITES}, kept AS (SELECT * FROM websites WHERE counts >= {MIN_WEBSITE_PAGES})
            SELECT website AS id, website AS label, '' AS parent, counts AS value,
                   counts / (SELECT CAST(sum(counts) AS DOUBLE) FROM kept) AS share
            FROM kept""",
        "website_reconcile_nulls": """
            SELECT count(*) FILTER (page_id % 7 <> 0) AS total, count(*) AS expected,
                   count(*) FILTER (page_id % 7 = 0) AS null_rows, count(*) FILTER (page_id % 7 = 0) = 0 AS ok
            FROM pages""",
        "treemap_levels": f"""
            WITH {SQL_WEBSITES}, kept AS (
                SELECT string_split(website, '.')[-1] AS suffix, website, CAST(counts AS DOUBLE) AS counts FROM websites
            ), nodes AS (
                SELECT suffix AS id, suffix AS label, '' AS parent, counts FROM kept
                UNION ALL SELECT suffix || '/' || website, website, suffix, counts FROM kept
            )
            SELECT id, label, parent, CAST(sum(counts) AS BIGINT) AS value,
                   sum(counts) / (SELECT sum(counts) FROM kept) AS share
            FROM nodes GROUP BY id, label, parent""",
        "host_threshold": rf"""
            SELECT host, count(*) AS counts
            FROM (SELECT regexp_extract(lower(url), '://([\w\-.]+)', 1) AS host FROM pages)
            GROUP BY host HAVING count(*) >= {MIN_HOST_PAGES} ORDER BY counts DESC, host""",
        "text_normalize": f"SELECT doc_id, {SQL_NORMALIZED} AS text FROM documents",
        "numeral_unify": f"""
            SELECT doc_id, translate({SQL_ARABIC}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS text
            FROM documents""",
        "cast_string": """
            SELECT doc_id, CAST(n_chars AS VARCHAR) AS n_chars,
                   CASE WHEN n_chars >= 1000 THEN CAST(n_chars AS VARCHAR) END AS long_or_null,
                   CASE WHEN n_chars >= 1000 THEN CAST(n_chars AS VARCHAR) ELSE 'None' END AS long_or_none
            FROM documents""",
        "normalized_dedup": f"""
            SELECT min(doc_id) AS doc_id, text
            FROM (SELECT doc_id, {SQL_NORMALIZED} AS text FROM documents) GROUP BY text""",
        "text_profile": """
            WITH groups AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)
            SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
                   (SELECT text FROM groups ORDER BY n DESC, text LIMIT 1) AS top, max(n) AS freq
            FROM groups""",
        "text_profile_first_seen": """
            WITH groups AS (
                SELECT text, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text
            )
            SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
                   (SELECT text FROM groups ORDER BY n DESC, first LIMIT 1) AS top, max(n) AS freq,
                   (SELECT first FROM groups ORDER BY n DESC, first LIMIT 1) AS top_key
            FROM groups""",
        # both estimates and exact numbers are worked out in the query; the numbers must agree, and the estimates be close
        "distinct_sketch": """
            SELECT lang, count(DISTINCT text) AS n_exact, true AS within FROM documents GROUP BY lang
            UNION ALL SELECT NULL, count(DISTINCT text), true FROM documents""",
        "table_profile": """
            SELECT 0 AS position, 'doc_id' AS "column", count(doc_id) AS non_null, 'bigint' AS dtype FROM documents
            UNION ALL SELECT 1, 'text', count(text), 'string' FROM documents
            UNION ALL SELECT 2, 'lang', count(lang), 'string' FROM documents
            UNION ALL SELECT 3, 'source', count(source), 'string' FROM documents
            UNION ALL SELECT 4, 'n_chars', count(n_chars), 'bigint' FROM documents""",
        "duplicate_flag": """
            SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents""",
        "duplicate_count": """
            SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct,
                   count(*) - count(DISTINCT text) AS n_duplicates
            FROM documents""",
        "duplicate_rows": """
            SELECT doc_id, text, lang, source, n_chars FROM documents
            QUALIFY count(*) OVER (PARTITION BY text) > 1""",
        "duplicate_head": """
            SELECT doc_id, text, lang, source, n_chars FROM documents
            QUALIFY count(*) OVER (PARTITION BY text) > 1 ORDER BY text, doc_id LIMIT 10""",
        "dedup": """
            SELECT doc_id, text, lang, source, n_chars FROM documents
            QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
        # doc_id grows with the place in the file
        "dedup_input_order": """
            SELECT text, lang, source, n_chars FROM documents
            QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
        "dedup_count": "SELECT count(DISTINCT text) AS n_rows FROM documents",
        "tokens_head": rf"""
            WITH {SQL_DISTINCT}
            SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, corpus
            FROM (
                SELECT doc_id, unnest(words) AS corpus, generate_subscripts(words, 1) AS pos
                FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS words FROM distinct_texts)
            )
            ORDER BY doc_id, pos LIMIT 5""",
        "token_counts": f"WITH {SQL_TOKENS} SELECT corpus, count(*) AS countv FROM tokens GROUP BY corpus",
        "top_tokens": f"""
            WITH {SQL_TOKENS} SELECT corpus, count(*) AS countv FROM tokens
            GROUP BY corpus ORDER BY countv DESC, corpus LIMIT 10""",
        "top_tokens_first_seen": rf"""
            WITH {SQL_DISTINCT}, placed AS (
                SELECT doc_id, unnest(words) AS corpus, generate_subscripts(words, 1) AS pos
                FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS words FROM distinct_texts)
            )
            SELECT corpus, count(*) AS countv FROM placed
            GROUP BY corpus ORDER BY countv DESC, min((doc_id, pos)) LIMIT 10""",
        "word_count_hist": f"""
            WITH {SQL_LENGTHS}
            SELECT n_words || ' words:' AS words, n_words, n_rows FROM lengths ORDER BY words""",
        "word_count_stats": f"""
            WITH {SQL_LENGTHS}
            SELECT avg(n_rows) AS mean_rows_per_length,
                   CAST(sum(n_words * n_rows) AS DOUBLE) / CAST(sum(n_rows) AS DOUBLE) AS avg_words_per_row
            FROM lengths""",
        # Written as the self-join of plurals with their singulars, not as a grouping by base.
        "term_weights": rf"""
            WITH {SQL_DISTINCT}, raw AS (
                SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']*')) AS raw
                FROM distinct_texts
            ), trimmed AS (
                SELECT CASE WHEN lower(raw) LIKE '%''s' THEN left(raw, len(raw) - 2) ELSE raw END AS form FROM raw
            ), forms AS (
                SELECT form, lower(form) AS key, count(*) AS n FROM trimmed
                WHERE NOT regexp_full_match(form, '\p{{Nd}}+') AND lower(form) NOT IN {STOP_WORDS!r}
                GROUP BY form
            ), keys AS (SELECT DISTINCT key FROM forms), merged AS (
                SELECT coalesce(s.key, f.key) AS term,
                       CASE WHEN s.key IS NULL THEN f.form ELSE left(f.form, len(f.form) - 1) END AS shown, n
                FROM forms f LEFT JOIN keys s
                  ON f.key LIKE '%s' AND f.key NOT LIKE '%ss' AND s.key = left(f.key, len(f.key) - 1)
            ), spellings AS (
                SELECT term, shown, sum(n) AS n FROM merged GROUP BY term, shown
            ), ranked AS (
                SELECT term, shown, CAST(sum(n) OVER (PARTITION BY term) AS BIGINT) AS n,
                       row_number() OVER (PARTITION BY term ORDER BY n DESC, shown) AS r
                FROM spellings
            ), kept AS (
                SELECT term, shown, n FROM ranked WHERE r = 1 ORDER BY n DESC, term LIMIT 2000
            )
            SELECT term, shown, n, n / CAST(max(n) OVER () AS DOUBLE) AS weight FROM kept""",
    }
