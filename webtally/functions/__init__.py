from webtally.functions.digest import text_digest
from webtally.functions.normalize import SORANI_ARABIC, normalize_text, unify_numerals
from webtally.functions.tokens import has_words, raw_terms, tokens, word_count
from webtally.functions.urls import host_name, host_of, website_of

__all__ = [
    "SORANI_ARABIC",
    "has_words",
    "host_name",
    "host_of",
    "normalize_text",
    "raw_terms",
    "text_digest",
    "tokens",
    "unify_numerals",
    "website_of",
    "word_count",
]
