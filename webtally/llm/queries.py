"""The operators applied to the whole of their tables, as the registry's queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webtally.llm import (
    bpe,
    decontaminate,
    kneser_ney,
    language_id,
    line_dedup,
    ngram_join,
    pii,
    pivot_index,
    prefix_trie,
    secret_scan,
    source_mix,
    tokenizer_alignment,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def _number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def _span_digests(found: DataFrame, base: list[str]) -> DataFrame:
    """Numbers of base spans by kind, their digest, and all spans, from ``doc_id, spans``."""
    spans = F.col("spans")
    own = F.filter(spans, lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id",
        *[_number_of(spans, kind) for kind in base],
        F.sha2(secret_scan.written(own), 256).alias("base_sha256"),
        secret_scan.written(spans).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return _span_digests(found, [rule.kind for rule in secret_scan.BASE_RULES])


# The chain: whether a document is of low quality, then whether it is toxic.
CATEGORIES = ("low_quality", "toxic")


def categories(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(table(spark, sf_dir, "documents"), categories(table(spark, sf_dir, "labels")), CATEGORIES)
    return scores.withColumn("toxic", F.col("p_toxic") >= toxicity.LIMIT)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op6_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_held_out(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.find(table(spark, sf_dir, "documents")), list(pii.KINDS))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents).select(
        "doc_id",
        F.col("deduped.n_lines"),
        F.col("deduped.n_dropped"),
        F.sha2(F.col("deduped.text"), 256).alias("kept_sha256"),
    )


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("copies")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    block = prefix_trie.block_size(turns)
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns, block), block)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = tokenizer_alignment.read_vocabularies(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return tokenizer_alignment.align(table(spark, sf_dir, "documents"), vocabularies)


SQL_LINE_DEDUP = r"""
    WITH lines AS (
        SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    ), keyed AS (
        SELECT doc_id, line, pos,
               translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), frequent AS (
        SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (
        SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.holder AS dropped
        FROM keyed k LEFT JOIN frequent f ON k.key = f.key
    )
    SELECT doc_id, count(*) AS n_lines,
           CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""

def sql_source_mix() -> str:
    """The mix with its rounds written out: targets settle in a few of them, and eight fill what is left."""
    levels = ["level0 AS (SELECT total / (SELECT sum(w) FROM places) AS level FROM words)"]
    for i in range(1, 8):
        levels.append(f"""level{i} AS (
            SELECT (any_value(total) - sum(CASE WHEN level * w > 2 * source_size THEN 2 * source_size ELSE 0 END))
                   / sum(CASE WHEN level * w > 2 * source_size THEN 0 ELSE w END) AS level
            FROM places, level{i - 1}, words)""")
    rounds = ["""round0 AS (
        SELECT *, false AS extra, target - sum(whole * size) OVER (PARTITION BY place) AS gap FROM ranked)"""]
    for i in range(1, source_mix.ROUNDS + 1):
        rounds.append(f"""open{i} AS (
            SELECT *, coalesce(gap > target * {source_mix.TOLERANCE} AND gap >= 1 AND NOT extra AND size <= gap
                               AND score IS NOT NULL, false) AS o
            FROM round{i - 1}
        ), fit{i} AS (
            SELECT *, o AND sum(CASE WHEN o THEN size ELSE 0 END) OVER (PARTITION BY place ORDER BY score) <= gap AS f
            FROM open{i}
        ), round{i} AS (
            SELECT * EXCLUDE (o, f) REPLACE (
                extra OR f AS extra, gap - sum(CASE WHEN f THEN size ELSE 0 END) OVER (PARTITION BY place) AS gap)
            FROM fit{i})""")
    return rf"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
               (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT
                + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
        FROM documents
    ), words AS (
        SELECT coalesce(sum(size), 0)::DOUBLE * 1.5::DOUBLE AS total FROM sized
    ), places AS (
        SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
               [5, 2, 1][(place % 3 + 1)::INTEGER]::DOUBLE AS w
        FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
    ), {", ".join(levels)}, targets AS (
        SELECT source, source_size, place, least(2 * source_size, level * w)::DOUBLE AS target FROM places, level7
    ), expected AS (
        SELECT doc_id, size, u, source_size, place, target,
               CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END::DOUBLE AS copies
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    ), ranked AS (
        SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS chance,
               CASE WHEN chance > 0 AND size > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS score
        FROM expected
    ), {", ".join(rounds)}
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (size * (whole + CASE WHEN extra THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM round{source_mix.ROUNDS}"""


# Totals from each conversation's own path: what a node and those below it that have the same smallest
# member count, summed from the end of the path, and these sums added up over the members.
SQL_PREFIX_TRIE = r"""
    WITH turns AS (
        SELECT conv_id AS c, row_number() OVER (
                   PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
               length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
               strlen(coalesce(text, '')) AS n_bytes
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT c, count(*) AS n,
               xor(list_reduce(
                   list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                   lambda crc, byte: list_reduce(
                       [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
               ), 4294967295) % 9 AS h
        FROM turns GROUP BY c
    ), starts AS (
        SELECT a.c, a.n, a.h, a.c - a.c % 5 AS base, least(a.h, coalesce(b.n, 0)) AS lent
        FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 5
    ), rebuilt AS (
        SELECT s.c, t.place AS d, t.said, t.n_bytes FROM starts s JOIN turns t ON t.c = s.base AND t.place <= s.h
        UNION ALL
        SELECT s.c, s.lent + t.place - s.h, t.said, t.n_bytes FROM starts s JOIN turns t ON t.c = s.c AND t.place > s.h
    ), steps AS (
        SELECT c, 0 AS d, '' AS said, 0 AS n_bytes FROM starts
        UNION ALL SELECT c, d, md5(said), n_bytes FROM rebuilt
    ), paths AS (
        SELECT c, d, n_bytes, string_agg(said, ',') OVER (PARTITION BY c ORDER BY d) AS node,
               d = max(d) OVER (PARTITION BY c) AS last
        FROM steps
    ), placed AS (
        SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent FROM paths
    ), nodes AS (
        SELECT d, node, any_value(parent) AS parent, min(c) AS owner, count(*) AS n_convs, max(n_bytes) AS n_bytes,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
        FROM placed GROUP BY d, node
    ), children AS (
        SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.parent = n.node) AS n_children FROM nodes n
    ), sums AS (
        SELECT p.d, p.node,
               sum(CASE WHEN p.c = k.owner AND k.n_children = 0 THEN 1 ELSE 0 END) OVER below AS leaves,
               sum(CASE WHEN p.c = k.owner THEN (k.n_convs - 1) * k.n_bytes ELSE 0 END) OVER below AS saved
        FROM placed p JOIN children k ON p.d = k.d AND p.node = k.node
        WINDOW below AS (PARTITION BY p.c ORDER BY p.d DESC)
    ), totals AS (
        SELECT d, node, sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM sums GROUP BY d, node
    )
    SELECT k.owner AS conv_id, k.d::BIGINT AS depth, p.owner AS parent_conv_id, k.n_convs, k.n_children, t.n_leaves,
           t.saved_tokens, k.ends_sha256
    FROM children k JOIN totals t ON t.d = k.d AND t.node = k.node
    LEFT JOIN nodes p ON p.d = k.d - 1 AND p.node = k.parent"""

QUERIES = (
    op1_ngram_join, op2_secret_scan, op3_toxicity, op4_decontaminate, op5_language_id,
    op6_pivot_index, op7_kneser_ney, op8_bpe, op9_pii, op10_line_dedup,
    op11_source_mix, op12_prefix_trie, op13_tokenizer_alignment,
)

ORACLE_SQL = {
    "op10_line_dedup": SQL_LINE_DEDUP,
    "op11_source_mix": sql_source_mix(),
    "op12_prefix_trie": SQL_PREFIX_TRIE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}
