"""Analyse a corpus and write its report tables.

    python -m webtally CORPUS OUT --suffixes public_suffix_list.dat
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from webtally.plans.materialize import scratch
from webtally.plans.reports import corpus_report
from webtally.sources import publish_tables, read_corpus, read_suffix_list, write_tables


def parse_args(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="webtally", description="Analyse a corpus and write its report tables.")
    parser.add_argument("corpus", help="folder or file of the corpus")
    parser.add_argument("out", help="folder for the report tables")
    parser.add_argument("--suffixes", required=True, help="file in the published public-suffix format")
    parser.add_argument("--format", default="parquet", help="format of the corpus")
    parser.add_argument("--out-format", default="parquet", help="format of the report tables")
    parser.add_argument("--lang", help="keep this language only")
    parser.add_argument("--split", help="keep this split only")
    parser.add_argument("--key", default="id", help="unique column that puts the documents in order")
    parser.add_argument("--text", default="text", help="text column")
    parser.add_argument("--url", default="meta.warc_headers.`warc-target-uri`", help="URL column or field")
    parser.add_argument("--min-pages", type=int, default=1000, help="pages a website needs to be charted")
    parser.add_argument("--max-words", type=int, default=2000, help="terms to weigh")
    parser.add_argument("--stop-words", nargs="*", default=[], help="terms to leave out")
    parser.add_argument("--bucketed", type=int, metavar="BUCKETS", help="write cleaned texts by key; needs a catalog")
    parser.add_argument(
        "--publish", action="store_true", help="write a run of its own, which readers of the newest run see as a whole"
    )
    parser.add_argument("--null-as", help="text to use for missing texts")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    options = parse_args(args)
    spark = SparkSession.builder.appName("webtally").getOrCreate()
    with scratch():
        tables = corpus_report(
            read_corpus(spark, options.corpus, options.format, lang=options.lang, split=options.split),
            read_suffix_list(spark, options.suffixes),
            key=options.key,
            url=options.url,
            text=options.text,
            minimum=options.min_pages,
            max_words=options.max_words,
            stop_words=options.stop_words,
            null_as=options.null_as,
            buckets=options.bucketed,
        )
        write = publish_tables if options.publish else write_tables
        write(tables, options.out, options.out_format)


if __name__ == "__main__":
    main()
