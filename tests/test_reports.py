"""Reports that read their corpus once and appear whole, input order of any format, and stored sketches."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webtally.operators import dedup as dd, frequency as fq, profile as pf
from webtally.plans import reports
from webtally.plans.materialize import scratch
from webtally.sources import publish_tables, read_corpus, read_tables, suffix_rules, with_input_order

ROOT = Path(__file__).resolve().parents[1]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_report_reads_its_corpus_once(spark, tmp_path, monkeypatch):
    rows = [(i, None if i % 7 == 0 else f"text {i % 20}", f"http://h{i % 3}.example.uk/" if i % 5 else None, i % 2 or None) for i in range(200)]
    spark.createDataFrame(rows, "id bigint, text string, u string, odd bigint").write.parquet(f"{tmp_path}/corpus")
    df = spark.read.parquet(f"{tmp_path}/corpus")
    written = []
    kept = reports.materialize
    monkeypatch.setattr(reports, "materialize", lambda d, *a, **o: (written.append(executed(d)), kept(d, *a, **o))[1])
    with scratch():
        tables = reports.corpus_report(df, suffix_rules(spark, ["uk"]), "id", "u", minimum=1)
        scans = [p for p in [*written, *map(executed, tables.values())] if f"{tmp_path}/corpus" in p]
        # the pass that is kept, and the preview, which looks five keys up
        assert len(scans) == 2 and [p for p in scans if "In(id" in p or "id IN" in p] == scans[1:]
        assert tables["corpus_count"].first()["n_rows"] == 200
        assert tables["table_profile"].collect() == pf.table_profile(df).collect()
        assert [r["id"] for r in tables["corpus_head"].collect()] == [0, 1, 2, 3, 4]
        assert tables["corpus_head"].columns == df.columns
        assert tables["website_reconcile"].first()["null_rows"] == 40
        assert tables["meta_head"].collect() == pf.head(df.select("id", F.col("u").alias("url")), "id", 5).collect()


def test_a_failing_report_leaves_the_old_one(spark, tmp_path):
    out = f"{tmp_path}/out"
    publish_tables({"a": spark.range(3), "b": spark.range(2)}, out)
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        publish_tables({"a": spark.range(9), "b": broken}, out)
    assert {n: t.count() for n, t in read_tables(spark, out).items()} == {"a": 3, "b": 2}
    publish_tables({"a": spark.range(5)}, out, "json")
    assert {n: t.count() for n, t in read_tables(spark, out).items()} == {"a": 5}


@pytest.mark.parametrize("fmt", ["json", "orc", "parquet"])
def test_input_order_is_that_of_the_files(spark, tmp_path, fmt):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcdefghij") * 50 + str(rng.randrange(60))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    docs.repartitionByRange(3, "id").sortWithinPartitions("id").write.format(fmt).save(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # several splits a file
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        texts = with_input_order(read_corpus(spark, f"{tmp_path}/docs", fmt, docs.schema))
        assert fmt != "json" or texts.rdd.getNumPartitions() > 3
        assert [r["id"] for r in texts.orderBy("input_order").collect()] == list(range(3000))
        kept = dd.dedup(texts, "input_order").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {}
    for i, text in rows:
        first.setdefault(text, i)
    assert {r["text"]: r["id"] for r in kept} == first


def test_stored_sketches_merge(spark, tmp_path):
    """Two days with values in common; the crawls are not read again."""
    days = {d: spark.range(d * 3000, d * 3000 + 6000).select(F.col("id").cast("string").alias("v"), F.lit("ku").alias("lang")) for d in (0, 1)}
    for d, df in days.items():
        fq.distinct_sketches(df, "v", ["lang"]).write.parquet(f"{tmp_path}/day={d}")
    stored = spark.read.parquet(f"{tmp_path}/day=0", f"{tmp_path}/day=1")
    merged = fq.sketched_distinct(fq.merge_sketches(stored, ["lang"])).first()
    assert abs(merged["n_distinct"] - 9000) <= 9000 * 0.03 and merged["lang"] == "ku"
    empty = fq.sketched_distinct(fq.merge_sketches(fq.distinct_sketches(days[0].limit(0), "v", ["lang"]), []))
    assert empty.first()["n_distinct"] == 0


@pytest.mark.parametrize("module", ["xxhash", "public_tokenizers", "webtally.llm", "corpus_pipeline"])
def test_entry_without_a_module_of_the_training_data(module):
    code = (
        f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as c; q = c.queries();"
        "assert 'dedup' in q and 'pipeline' not in q and set(c.oracle_sql()) <= set(q), sorted(q)"
    )
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr
