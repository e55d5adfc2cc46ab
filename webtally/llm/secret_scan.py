"""Secrets in every version of every file, found once per distinct content.

Each historical version is a blob, addressed by the SHA-256 of its text. A *ledger* in
the shared folder records which blob was scanned with which version of which rule, and
the spans found. A scan works on the pairs of blob and rule version that the ledger
does not have: copies of a text, versions seen in an earlier scan and unchanged rules
cost a hash only. Findings are joined back to all paths that ever held the blob.

Built from Spark's own functions. Spans come from splitting a text at a rule's matches:
the pieces and the matches take turns, so their lengths add up to the positions.

Defined results: NULL and empty texts have no secrets. Texts of any length are scanned
whole. Rows that repeat a path or a text each get the findings of their blob. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from webtally.functions import text_digest
from webtally.llm.workspace import keyed_texts, new_folder


class Rule(NamedTuple):
    """A Java regular expression and its version.

    Matches are leftmost and do not overlap; those whose ``group`` has fewer than
    ``min_chars`` code points are dropped. ``contains`` is a string that is in every match.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 1
    contains: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The kinds of secrets every scan looks for. Runs of a class of characters
# that are long enough are the same whether a minimum is asked of the run or of the match.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        min_chars=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+", contains="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}+"),
)
# Key files and tokens with published formats.
MORE_RULES = (
    Rule(
        "pem",
        1,
        r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----",
        contains="-----BEGIN ",
    ),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", contains="eyJ"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", contains="gh"),
)
RULES = BASE_RULES + MORE_RULES


def _matches(rule: Rule) -> Column:
    """The text before each match, the match and its group, as lengths in code points.

    A text is split at the matches, so pieces and matches take turns. NULL without a match.
    """
    pattern, text = F.lit(rule.pattern), F.col("text")
    lengths = lambda strings: F.transform(strings, lambda x: F.length(x))
    found = F.arrays_zip(
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("group_size"),
        # one piece more than matches: the text after the last one, which is not needed
        lengths(F.split(text, rule.pattern, -1)).alias("before"),
    )
    some = text.rlike(rule.pattern)
    if rule.contains:
        some = F.when(text.contains(rule.contains), some)
    return F.when(
        some,
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.min_chars).alias("min_chars"),
            F.filter(found, lambda x: x["size"].isNotNull()).alias("found"),
        ),
    )


def scan_texts(texts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings in ``blob, text, done``: ``blob, rule, start, end`` (code points, end exclusive).

    ``done`` lists the rules that need not be run.
    """
    wanted = [F.when(~F.array_contains("done", r.name), _matches(r)) for r in rules]
    matched = texts.select("blob", F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("m"))
    placed = matched.select(
        "blob", "m.rule", "m.min_chars", F.posexplode("m.found").alias("at", "x")
    ).select("blob", "rule", "min_chars", "at", "x.*")
    # Positions are running sums over the matches of one rule in one text.
    upto = Window.partitionBy("blob", "rule").orderBy("at")
    end = F.sum((F.col("before") + F.col("size")).cast("bigint")).over(upto)
    return (
        placed.withColumn("end", end)
        .where("group_size >= min_chars")
        .select("blob", "rule", (F.col("end") - F.col("size")).alias("start"), "end")
    )


class BlobLedger:
    """Which blobs were scanned with which rule versions, and what was found.

    Two append-only Parquet folders: ``scans`` (``blob, rules``) and ``findings`` (``blob,
    rule, start, end``). Findings are written before the scans they belong to and read as a
    set, so a scan that is cut off anywhere can simply be run again.
    """

    SCANS = "blob binary, rules array<string>"
    FINDINGS = "blob binary, rule string, start bigint, end bigint"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        """Open the ledger at ``path``, in a new folder of the shared one by default."""
        self.spark, self.path = spark, path or new_folder(spark, "blob-ledger")
        for folder, schema in (("scans", self.SCANS), ("findings", self.FINDINGS)):
            # an append of no rows makes a new folder readable and leaves an old one as it is
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{folder}")

    def scans(self) -> DataFrame:
        return self.spark.read.schema(self.SCANS).parquet(f"{self.path}/scans")

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """Spans found with exactly these rule versions, each once."""
        found = self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings")
        return found.where(F.col("rule").isin([r.name for r in rules])).distinct()

    def scan(self, versions: DataFrame, rules: Sequence[Rule] = RULES) -> None:
        """Scan every blob of ``blob, text`` with those rules that it was not scanned with yet."""
        names = F.array(*[F.lit(r.name) for r in rules])
        done = self.scans().groupBy("blob").agg(
            F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done")
        )

        def unseen(blobs: DataFrame) -> DataFrame:
            left = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
            return left.where(F.size(F.array_except(names, "done")) > 0)

        known = versions.where("blob IS NOT NULL")
        # Copies are combined before the shuffle, so a text that fills a third of the rows is moved once per task.
        texts = unseen(known.groupBy("blob").agg(F.any_value("text").alias("text")))
        scan_texts(texts, rules).write.mode("append").parquet(f"{self.path}/findings")
        unseen(known.select("blob").distinct()).select("blob", F.array_except(names, "done").alias("rules")).write.mode(
            "append"
        ).parquet(f"{self.path}/scans")


def find_secrets(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    key: str = "doc_id",
    text: str = "text",
    ledger: BlobLedger | None = None,
) -> DataFrame:
    """Spans of every document: ``doc_id, spans`` with ``spans`` an array of rule, start and end.

    Spans are in order of their start and then of ``rules``. With a ledger of earlier scans
    only new texts and new rule versions are scanned.
    """
    versions = keyed_texts(docs, key, text).withColumn("blob", text_digest("text"))
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(versions.select("blob", "text"), rules)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    span = F.struct("start", F.element_at(order, F.col("rule")).alias("order"), "end", "rule")
    by_blob = ledger.findings(rules).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    found = versions.select("doc_id", "blob").join(by_blob, "blob", "left")
    kind = lambda x: F.substring_index(x["rule"], "@", 1).alias("kind")
    spans = F.transform("spans", lambda x: F.struct(kind(x), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("doc_id", F.coalesce(spans, F.array().cast(SPANS)).alias("spans"))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def written(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
