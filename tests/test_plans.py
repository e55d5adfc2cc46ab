"""Plans the queries must keep, the materialisation of shared results, and known totals."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from webtally.__main__ import main
from webtally.operators import dedup as dd, words as wd
from webtally.plans.materialize import materialize, scratch
from webtally.plans.reports import clean_texts, corpus_report
from webtally.session import CHECKPOINT_DIR
from webtally.sources import suffix_rules, write_bucketed, write_corpus

QUERIES = contract.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    """The plan after Spark has adapted it to what it found."""
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


@pytest.fixture
def large_tables(spark):
    """Joins as on tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(q.__name__ for q in contract.QUERIES))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD"):
        assert node not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("website_counts", "url:string"),
        ("page_website", "page_id:bigint,url:string"),
        ("corpus_count", ""),
        ("duplicate_count", "text:string"),
        ("dedup_count", "text:string"),
        ("token_counts", "doc_id:bigint,text:string"),
        ("term_weights", "doc_id:bigint,text:string"),
        ("word_count_hist", "doc_id:bigint,text:string"),
    ],
)
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", _plan(QUERIES[name](spark, sf_dir)))
    assert schemas and set(schemas) == {columns}


def test_language_filter_reaches_the_scan(spark, sf_dir):
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in _plan(QUERIES["corpus_select"](spark, sf_dir))


@pytest.mark.parametrize(
    "name", ["website_top", "duplicate_head", "tokens_head", "top_tokens", "term_weights", "corpus_head"]
)
def test_limits_are_top_k(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in _plan(QUERIES[name](spark, sf_dir))


def test_text_is_not_shuffled_to_flag_or_count_copies(spark, sf_dir):
    for name in ("duplicate_flag", "duplicate_count", "dedup_count", "text_profile_first_seen"):
        plan = _plan(QUERIES[name](spark, sf_dir))
        assert not re.search(r"Exchange hashpartitioning\(text", plan)
        assert not re.search(r"SortAggregate\(key=\[\w", plan)


def test_texts_are_shuffled_once_and_not_sorted(spark, sf_dir, large_tables):
    for name in ("dedup", "duplicate_rows"):
        plan = _final_plan(QUERIES[name](spark, sf_dir))
        assert "ShuffledHashJoin" in plan and "Sort" not in plan and "Window" not in plan
        assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan)) == 2
        assert plan.count("Exchange") == 3 and "Exchange hashpartitioning(text" not in plan


def test_bucketed_texts_are_not_shuffled(spark, sf_dir, tmp_path, large_tables):
    """On a table bucketed by key only digests and keys move, and the rows are the same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_bucketed(docs, "bucketed_docs", "doc_id", 6, f"{tmp_path}/docs")
    assert len(list((tmp_path / "docs").glob("*.parquet"))) == 6
    table = spark.table("bucketed_docs")
    try:
        for operator in (dd.dedup, dd.duplicate_rows, dd.duplicate_flags):
            got = operator(table, "doc_id")
            plan = _plan(got)
            # the digest, then the keys into the buckets of the table
            exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\d+)\)", plan)
            assert exchanges == [("doc_id", "6"), ("_groupingexpression", "8")]
            stream = plan[plan.index("SortMergeJoin") : plan.index("Exchange")]
            assert "FileScan" in stream and "Bucketed: true" in stream
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, operator(docs, "doc_id").collect()))
    finally:
        spark.sql("DROP TABLE bucketed_docs")


def test_pages_need_no_shuffle_for_their_website(spark, sf_dir):
    plan = _plan(QUERIES["page_website"](spark, sf_dir))
    pages = plan[: plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in pages and not re.search(r"Exchange (hash|range|Single|RoundRobin)", pages)


def test_pages_are_counted_before_each_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["website_counts"](spark, sf_dir))
    for key in ("host", "website"):
        exchange = plan.index(f"Exchange hashpartitioning({key}#")
        assert re.match(rf".*\n[^\n]*HashAggregate\(keys=\[{key}#\d+\], functions=\[partial_", plan[exchange:])


def test_known_totals(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert tuple(dd.duplicate_count(docs).first()) == (1000, 927, 73)
    assert dd.duplicate_rows(docs, "doc_id").count() == 135
    texts = dd.dedup(docs, "doc_id")
    assert tuple(wd.token_counts(texts).agg(F.sum("countv"), F.count("*")).first()) == (364249, 93796)
    hist = wd.word_count_hist(texts)
    totals = hist.agg(F.count("*"), F.sum("n_rows"), F.sum(F.col("n_words") * F.col("n_rows"))).first()
    assert tuple(totals) == (520, 927, 364249)
    stats = wd.word_count_stats(hist).first()
    assert round(stats.mean_rows_per_length, 2) == 1.78 and round(stats.avg_words_per_row, 2) == 392.93


def test_known_websites(spark, sf_dir):
    assert {tuple(r) for r in QUERIES["website_counts"](spark, sf_dir).collect()} == {
        ("example.com", 94),
        ("example.net", 102),
        ("example.org", 54),
    }
    assert QUERIES["url_host"](spark, sf_dir).select("host").distinct().count() == 58
    assert QUERIES["website_threshold"](spark, sf_dir).count() == 2
    assert QUERIES["host_threshold"](spark, sf_dir).count() == 4
    assert QUERIES["website_treemap"](spark, sf_dir).agg(F.sum("share")).first()[0] == pytest.approx(1)


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spread = docs.repartition(13, F.xxhash64("doc_id"))
    for run in (
        lambda df: dd.dedup(df, "doc_id"),
        lambda df: dd.duplicate_flags(df.select("doc_id", "text"), "doc_id"),
        lambda df: wd.top_tokens_first_seen(df, "doc_id"),
        lambda df: wd.term_weights(df, 50),
    ):
        assert sorted(map(tuple, run(docs).collect())) == sorted(map(tuple, run(spread).collect()))


def test_materialize_uses_the_folder_of_the_session(spark, tmp_path):
    folder = spark.conf.get(CHECKPOINT_DIR)
    kept = materialize(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert kept.agg(F.sum("x")).first()[0] == 90
    assert all(folder in file for file in kept.inputFiles())


def test_materialize_by_key(spark, large_tables):
    numbers = spark.range(1000).withColumn("text", (F.col("id") % 7).cast("string"))
    with scratch():
        kept = materialize(numbers, "by-key", bucket_by="id", buckets=3)
        assert dd.dedup(kept, "id").count() == 7
        assert "Bucketed: true" in _plan(dd.dedup(kept, "id")) and len(kept.inputFiles()) == 3
        assert len([t for t in spark.catalog.listTables() if "by_key" in t.name]) == 1
        folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert not folder.exists()
    assert not [t for t in spark.catalog.listTables() if "by_key" in t.name]
    with pytest.raises(ValueError, match="number of buckets"):
        materialize(numbers, "by-key", bucket_by="id")


def test_materialize_without_a_folder(spark, monkeypatch):
    monkeypatch.setattr("webtally.plans.materialize.shared_folder", lambda df: None)
    with scratch():
        kept = materialize(spark.range(10), "t")
        assert kept.is_cached and kept.count() == 10
    assert not kept.is_cached
    with pytest.raises(ValueError, match="shared folder"):
        materialize(spark.range(10), "t", bucket_by="id", buckets=2)


def test_report_shuffles_texts_once(spark, tmp_path, large_tables):
    """Duplicates and words are filters on one marked table."""
    numbers = spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("text"), F.lit("http://a.uk/").alias("u"))
    with scratch():
        tables = corpus_report(numbers, suffix_rules(spark, ["uk"]), "id", "u", minimum=1)
        for name in ("duplicate_head", "dedup_count", "top_tokens", "tokens_head"):
            assert not re.search(r"Join|Exchange hashpartitioning\((id|text)", _plan(tables[name]))
        assert tables["dedup_count"].first().n_rows == 7 and tables["duplicate_head"].count() == 10
        assert [r.id for r in tables["corpus_head"].collect()] == [0, 1, 2, 3, 4]
        assert tables["meta_head"].columns == ["id", "url"]
        folders = {Path(f.removeprefix("file://")).parent for f in tables["duplicate_head"].inputFiles()}
        assert len(folders) == 1 and all(f.exists() for f in folders)
    assert not any(f.exists() for f in folders)


@pytest.mark.parametrize("more", [[], ["--bucketed", "6"]])
def test_command_writes_every_report(spark, tmp_path, more):
    """The whole analysis on fixture documents with URLs and normalisable letters, and one missing text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    url = F.concat(F.lit("https://www."), F.col("source"), F.lit(".co.uk/"), F.col("doc_id"))
    corpus = docs.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") != 7, F.translate("text", "r", "ر")).alias("text"),
        F.struct(F.struct(url.alias("warc-target-uri")).alias("warc_headers")).alias("meta"),
        "lang",
    )
    write_corpus(corpus, f"{tmp_path}/corpus")
    (tmp_path / "suffixes.dat").write_text("===BEGIN ICANN DOMAINS===\nuk\nco.uk\n===END ICANN DOMAINS===\n")
    options = ["--suffixes", f"{tmp_path}/suffixes.dat", "--min-pages", "2", "--lang", "en", *more]
    shared = Path(spark.conf.get(CHECKPOINT_DIR).removeprefix("file://"))
    before = set(shared.glob("webtally-*"))
    main([f"{tmp_path}/corpus", f"{tmp_path}/out", *options])

    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    english = corpus.where("lang = 'en'")
    assert read("corpus_count").first().n_rows == english.count()
    want = {(f"{r.source}.co.uk", r["count"]) for r in docs.where("lang = 'en'").groupBy("source").count().collect()}
    assert {tuple(r) for r in read("website_counts").collect()} == want
    assert read("website_distinct").first()[0] == len(want)
    assert read("website_reconcile").first().ok
    assert {r.label for r in read("website_treemap").collect()} == {site for site, n in want if n >= 2}
    non_null = {r.column: r.non_null for r in read("table_profile").collect()}
    assert non_null["text"] == english.where("text is not null").count()
    assert {r.column: r.non_null for r in read("clean_profile").collect()}["id"] == english.count()
    assert read("corpus_head").count() == read("meta_head").count() == 5
    assert set(shared.glob("webtally-*")) == before
    assert not [t for t in spark.catalog.listTables() if "clean_texts" in t.name]

    cleaned = clean_texts(english.select("id", "text"))
    profile, counts = read("text_profile").first(), read("duplicate_count").first()
    n_null = english.where("text is null").count()
    assert profile["count"] == counts.n_rows - n_null and counts.n_rows == english.count()
    assert counts.n_distinct == read("dedup_count").first().n_rows == cleaned.select("text").distinct().count()
    hist = read("word_count_hist")
    assert hist.agg(F.sum("n_rows")).first()[0] == profile.unique
    assert read("word_count_stats").first().mean_rows_per_length == profile.unique / hist.count()
    top = [tuple(r) for r in read("top_tokens").orderBy(F.desc("countv"), "corpus").collect()]
    assert top == [tuple(r) for r in wd.top_tokens(dd.dedup(cleaned, "id")).collect()]
    assert any("ڕ" in r.term for r in read("term_weights").collect())
    assert read("tokens_head").count() == 5 and read("duplicate_head").count() <= 10
