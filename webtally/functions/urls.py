"""Host names and websites of URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Optional scheme, then everything up to the last @ of the authority, then the host:
# not in brackets (an IPv6 literal), and without dots around it. Nothing before the
# host may be given back to find another match.
AUTHORITY_HOST = (
    r"^\s*+(?:(?:[A-Za-z0-9+.-]++:)?+//)?+(?:[^/?#]*@)?+\.*+"
    r"([^/?#:@\s\[](?:[^/?#:@\s]*[^/?#:@\s.])?)"
)

# The simpler rule: what follows "://", as far as word characters, dots and hyphens go.
HOST_AFTER_SCHEME = r"://([\p{L}\p{N}_.-]+)"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _first_match(text: Column, pattern: str) -> Column:
    """First group of the first match, NULL without one; runs the pattern once."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(0))


def host_name(url: Column | str) -> Column:
    """Host by the simple pattern, subdomains kept; NULL when nothing matches."""
    return F.lower(_first_match(_col(url), HOST_AFTER_SCHEME))


def host_of(url: Column | str) -> Column:
    """Host of a URL or bare host: no user, port, path or trailing dot, in lower case.

    NULL when there is none, and for IPv6 literals, which belong to no domain.
    """
    return F.lower(_first_match(_col(url), AUTHORITY_HOST))


def website_of(host: Column, suffix_length: Column, tidy: bool = False) -> Column:
    """``domain.suffix`` of a host whose public suffix has ``suffix_length`` labels.

    A missing part leaves its dot (``localhost.``, ``.co.uk``) unless ``tidy``.
    """
    labels = F.split(host, r"\.")
    n = F.array_size(labels)
    domain = F.coalesce(F.get(labels, n - suffix_length - 1), F.lit(""))
    suffix = F.array_join(F.slice(labels, n - suffix_length + 1, suffix_length), ".")
    is_ipv4 = host.rlike(IPV4)
    website = F.concat(
        F.when(is_ipv4, host).otherwise(domain), F.lit("."), F.when(is_ipv4, F.lit("")).otherwise(suffix)
    )
    return F.btrim(website, F.lit(".")) if tidy else website
