from webtally.sources.corpus import (
    CORPUS_SCHEMA,
    publish_tables,
    read_corpus,
    read_tables,
    select_corpus,
    with_input_order,
    write_bucketed,
    write_corpus,
    write_tables,
)
from webtally.sources.suffixes import read_suffix_list, suffix_rules

__all__ = [
    "CORPUS_SCHEMA",
    "publish_tables",
    "read_corpus",
    "read_suffix_list",
    "read_tables",
    "select_corpus",
    "suffix_rules",
    "with_input_order",
    "write_bucketed",
    "write_corpus",
    "write_tables",
]
