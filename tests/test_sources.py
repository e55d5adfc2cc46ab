import json

import pytest
from pyspark.sql import functions as F

from webtally.functions import host_of
from webtally.sources import read_corpus, read_suffix_list, write_corpus, write_tables

SUFFIX_LIST = """// a comment
// ===BEGIN ICANN DOMAINS===

// ck : comment
*.ck
!www.ck
COM trailing words do not count
  co.uk
рф
*.公司.cn
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
blogspot.com
// ===END PRIVATE DOMAINS===
"""


def test_suffix_list_file(spark, tmp_path):
    path = tmp_path / "suffixes.dat"
    path.write_text(SUFFIX_LIST)
    public = {("ck", "wild"), ("www.ck", "exc"), ("com", "std"), ("co.uk", "std")}
    public |= {("рф", "std"), ("xn--p1ai", "std"), ("公司.cn", "wild"), ("xn--55qx5d.cn", "wild")}
    assert {tuple(r) for r in read_suffix_list(spark, str(path)).collect()} == public
    everything = read_suffix_list(spark, str(path), private=True)
    assert {tuple(r) for r in everything.collect()} == public | {("blogspot.com", "std")}


def test_json_lines_without_inference(spark, tmp_path):
    records = [
        {"id": 1, "text": "a", "meta": {"warc_headers": {"warc-target-uri": "http://x.org/", "other": 1}, "more": []}},
        {"id": 2, "text": "b", "meta": {"warc_headers": {}}},
        {"id": 3, "meta": None},
    ]
    (tmp_path / "part.json").write_text("\n".join(map(json.dumps, records)))
    df = read_corpus(spark, str(tmp_path), fmt="json")
    got = df.select("id", "text", host_of("meta.warc_headers.`warc-target-uri`").alias("host")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x.org"), (2, "b", None), (3, None, None)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_language_and_split_prune_folders(spark, tmp_path, fmt):
    df = spark.range(90).select(
        "id",
        F.concat(F.lit("t"), F.col("id")).alias("text"),
        F.when(F.col("id") % 3 == 0, "ckb").otherwise("ku").alias("lang"),
        F.when(F.col("id") < 60, "train").otherwise("test").alias("split"),
    )
    write_corpus(df, str(tmp_path / "corpus"), ("lang", "split"), fmt)
    chosen = read_corpus(spark, str(tmp_path / "corpus"), fmt, lang="ckb", split="train")
    assert sorted(r.id for r in chosen.collect()) == list(range(0, 60, 3))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan
    assert read_corpus(spark, str(tmp_path / "corpus"), fmt).count() == 90


def test_a_common_language_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 20000, 1, 8).select(
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.when(F.col("id") % 10 < 9, "ku").otherwise("ckb").alias("lang"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        write_corpus(rows, f"{tmp_path}/corpus")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {lang: len(list((tmp_path / "corpus" / f"lang={lang}").glob("*.parquet"))) for lang in ("ku", "ckb")}
    assert files["ku"] >= 4 > files["ckb"]
    assert read_corpus(spark, f"{tmp_path}/corpus").distinct().count() == 20000


def test_report_tables(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    write_tables(tables, f"{tmp_path}/out/", "json")
    write_tables(tables, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/a").count() == 3
    assert spark.read.parquet(f"{tmp_path}/out/b").count() == 2


def test_unmarked_suffix_list_is_refused_or_taken_whole(spark, tmp_path):
    (tmp_path / "list.dat").write_text("com\nco.uk\n")
    with pytest.raises(ValueError, match="no ICANN section"):
        read_suffix_list(spark, str(tmp_path / "list.dat"))
    rules = read_suffix_list(spark, str(tmp_path / "list.dat"), marked=False)
    assert {tuple(r) for r in rules.collect()} == {("com", "std"), ("co.uk", "std")}


def test_ids_of_another_type_fail_the_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x1", "text": "a"}\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        read_corpus(spark, str(tmp_path), "json").collect()
