"""URLs and hosts inside text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as a link, for features and for the denylist rule.
FEATURE_URL = r"(?i)https?://[^\s\"'<>)]+"
RULE_AUTHORITY = r"(?i)https?://([^/\s\"'>)\]]+)"
IPV4_HOST = r"^(\d{1,3}\.){3}\d{1,3}$"


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FEATURE_URL), F.lit(0))


def host_of_authority(authority: Column) -> Column:
    """Drop userinfo and port; null when nothing is left."""
    bare = F.substring_index(F.substring_index(authority, "@", -1), ":", 1)
    return F.nullif(F.lower(bare), F.lit(""))


def url_host(url: Column) -> Column:
    """Host of an absolute URL; tolerant of malformed input, unlike ``parse_url``."""
    rest = F.regexp_replace(url, r"^[^:]*://", "")
    return host_of_authority(F.regexp_extract(rest, r"^[^/?#]*", 0))


def rule_hosts(text: Column) -> Column:
    """Distinct non-blank hosts the denylist rule looks at."""
    found = F.transform(F.regexp_extract_all(text, F.lit(RULE_AUTHORITY), F.lit(1)), host_of_authority)
    return F.array_distinct(F.filter(found, lambda h: F.length(F.btrim(h)) > 0))


def domain_suffixes(host: Column) -> Column:
    """The host itself and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
