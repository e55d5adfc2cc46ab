import re

import pytest
from pyspark.sql import functions as F

from webtally.functions import host_name, host_of
from webtally.operators import frequency as fq, websites as ws
from webtally.sources import suffix_rules

RULES = (
    "com", "net", "org", "uk", "co.uk", "jp", "ac.jp", "a.b.c.d.test",
    "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp",
)

WEBSITES = {
    "www.example.co.uk": "example.co.uk",
    "example.co.uk": "example.co.uk",
    "co.uk": ".co.uk",
    "uk": ".uk",
    "foo.blogspot.com": "blogspot.com",
    "a.b.ck": "a.b.ck",
    "x.a.b.ck": "a.b.ck",
    "b.ck": ".b.ck",
    "x.www.ck": "www.ck",
    "www.ck": "www.ck",
    "a.city.kawasaki.jp": "city.kawasaki.jp",
    "a.b.kawasaki.jp": "a.b.kawasaki.jp",
    "x.a.b.kawasaki.jp": "a.b.kawasaki.jp",
    "u.ac.jp": "u.ac.jp",
    "localhost": "localhost.",
    "foo.unknowntld": "unknowntld.",
    "127.0.0.1": "127.0.0.1.",
    "300.0.0.1": "1.",
    "www.site.a.b.c.d.test": "site.a.b.c.d.test",
}


@pytest.fixture(scope="module")
def hosts(spark):
    return spark.createDataFrame([(i, h) for i, h in enumerate(WEBSITES)] + [(99, None)], "id int, host string")


@pytest.fixture(scope="module")
def rules(spark):
    return suffix_rules(spark, RULES)


@pytest.mark.parametrize("options", [{}, {"max_broadcast_rules": 0}, {"max_broadcast_bytes": 0}])
def test_websites_of_hosts(hosts, rules, options):
    got = {r.host: r.website for r in ws.with_website(hosts, rules, **options).collect()}
    assert got == {**WEBSITES, None: None}


def test_large_rule_table_is_not_broadcast(spark, hosts, rules):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        salted = ws.with_website(hosts, rules, max_broadcast_rules=0)
        plan = salted._jdf.queryExecution().executedPlan().toString()
        # the heavy candidates are broadcast, the rules are not
        assert re.search(r"SortMergeJoin[^\n]*_rule\d+_rule#", plan)
        assert not re.search(r"BroadcastHashJoin[^\n]*_rule\d+_rule#", plan)
        assert {r.host: r.website for r in salted.collect()} == {**WEBSITES, None: None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_of_one_host_stay_spread_without_broadcast(spark, rules):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pages = spark.range(20000).withColumn("url", F.lit("http://www.hot.co.uk/"))
        sites = ws.page_websites(pages, rules, "id", "url", max_broadcast_rules=0)
        sizes = [r["count"] for r in sites.groupBy("website", F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) < 0.4 * 20000
        assert sites.select("website").distinct().collect() == [("hot.co.uk",)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_only_rules_of_heavy_candidates_are_copied(spark):
    pages = spark.range(9000).select(
        F.when(F.col("id") < 3000, F.lit("a.hot.uk")).when(F.col("id") < 8000, F.concat(F.lit("h"), "id", F.lit(".s"), "id")).alias("host")
    )
    heavy = ws.heavy_candidates(pages, "host", 2, 30)
    assert {tuple(r) for r in heavy.collect()} == {("uk", 10), ("hot.uk", 10)}
    rules = spark.range(20000).select(F.concat(F.lit("s"), "id").alias("rule")).union(spark.createDataFrame([("uk",)], "rule string"))
    copied = ws.copied_rules(rules, heavy).groupBy("rule").count().where("count > 1").collect()
    assert [tuple(r) for r in copied] == [("uk", 10)]


def test_without_broadcast_the_websites_are_the_same(spark, rules):
    hosts = [f"{a}.{b}" for a in ("www.x", "y", "") for b in ("co.uk", "ck", "kawasaki.jp", "city.kawasaki.jp", "com", "none")]
    rows = [(i, hosts[i % 7 if i % 3 else i % len(hosts)] if i % 5 else None) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, host string")
    got = ws.with_website(table, rules, max_broadcast_rules=0).orderBy("id").collect()
    assert got == ws.with_website(table, rules).orderBy("id").collect()


def test_repeated_rules_do_not_repeat_rows(spark, hosts):
    doubled = suffix_rules(spark, RULES + RULES)
    assert ws.with_website(hosts, doubled).count() == hosts.count()


def test_without_rules_the_last_label_is_the_domain(spark, hosts):
    got = {r.host: r.website for r in ws.with_website(hosts, suffix_rules(spark, ())).collect()}
    assert got["www.example.co.uk"] == "uk." and got["127.0.0.1"] == "127.0.0.1."


def test_internationalised_suffixes(spark):
    cases = {
        "www.xn--e1afmkfd.xn--p1ai": "xn--e1afmkfd.xn--p1ai",
        "www.пример.рф": "пример.рф",
        "a.b.com": "b.com",
    }
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    got = ws.with_website(hosts, suffix_rules(spark, ("com", "рф"))).collect()
    assert {r.host: r.website for r in got} == cases


def test_tidy_websites(hosts, rules):
    got = {r.host: r.website for r in ws.with_website(hosts, rules, tidy=True).collect()}
    assert (got["localhost"], got["co.uk"], got["127.0.0.1"]) == ("localhost", "co.uk", "127.0.0.1")


HOSTS = {
    "http://WWW.Example.COM/Path": "www.example.com",
    "https://user:pw@host.org:8080/a@b?c=d": "host.org",
    "https://a@b@host.org/": "host.org",
    "http://host.org.": "host.org",
    "http://host.org./x": "host.org",
    "http://h/x": "h",
    "http://under_score.example.com?q": "under_score.example.com",
    "//cdn.example.net#top": "cdn.example.net",
    "forums.example.co.uk": "forums.example.co.uk",
    "http://[2001:db8::1]:80/": None,
    "http://user@[::1]/": None,
    "http:///path": None,
    "http://...": None,
    "": None,
    None: None,
}


def test_hosts_of_urls(spark):
    urls = spark.createDataFrame([(u,) for u in HOSTS], "url string")
    assert {r.url: r.host for r in urls.select("url", host_of("url").alias("host")).collect()} == HOSTS


def test_simple_host_pattern(spark):
    cases = {
        "http://www.Example.com:80/x": "www.example.com",
        "https://münchen.example.de/": "münchen.example.de",
        "https://a.b/?next=http://c.d": "a.b",
        "a.b/c": None,
        None: None,
    }
    urls = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.host for r in urls.select("url", host_name("url").alias("host")).collect()} == cases


@pytest.fixture(scope="module")
def crawl(spark):
    urls = ["http://a.x.com"] * 3 + ["http://b.x.com"] * 2 + ["http://y.org/1", "http://z.org", "http://[::1]/", None]
    return spark.createDataFrame(list(enumerate(urls)), "id int, url string")


def test_website_frequencies(spark, crawl, rules):
    freq = ws.website_counts(crawl, rules, "url")
    assert [tuple(r) for r in fq.by_frequency(freq, "website").collect()] == [("x.com", 5), ("y.org", 1), ("z.org", 1)]
    assert [tuple(r) for r in fq.top(freq, "website", 2).collect()] == [("x.com", 5), ("y.org", 1)]
    assert [tuple(r) for r in fq.at_least(freq, 5).collect()] == [("x.com", 5)]
    assert fq.distinct_values(freq).first()[0] == 3


def test_reconcile_reports_rows_without_website(spark, crawl, rules):
    got = ws.reconcile_websites(crawl, rules, "url").first()
    assert got.asDict() == {"total": 7, "expected": 9, "null_rows": 2, "ok": False}
    assert ws.reconcile_websites(crawl, rules, "url", expected=7).first().ok
    empty = ws.reconcile_websites(crawl.where("false"), rules, "url").first()
    assert empty.asDict() == {"total": 0, "expected": 0, "null_rows": 0, "ok": True}


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "v string")
    assert {tuple(r) for r in fq.value_counts(df, "v").collect()} == {("a", 2), ("b", 1)}


def test_approximate_number_of_values(spark):
    df = spark.range(50000).select((F.col("id") % 10000).cast("string").alias("v"))
    assert abs(fq.approx_distinct(df, "v").first().n_distinct - 10000) < 1000


def test_treemap_levels(spark):
    rows = [("org", "a", 1), ("org", "b", 3), ("com", "c", 4)]
    freq = spark.createDataFrame(rows, "tld string, site string, counts long")
    got = {r.id: (r.label, r.parent, r.value, r.share) for r in fq.treemap_nodes(freq, ["tld", "site"]).collect()}
    assert got == {
        "org": ("org", "", 4, 0.5),
        "com": ("com", "", 4, 0.5),
        "org/a": ("a", "org", 1, 0.125),
        "org/b": ("b", "org", 3, 0.375),
        "com/c": ("c", "com", 4, 0.5),
    }
    one = fq.treemap_nodes(freq, ["site"]).agg(F.sum("share"), F.count("*")).first()
    assert tuple(one) == (1.0, 3)
