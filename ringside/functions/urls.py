"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ringside.functions.text import slug_ascii

LINK_PATTERN = r"(https?://\S+)"


def extract_links(text: Column) -> Column:
    """All links in order, duplicates kept."""
    return F.regexp_extract_all(text, F.lit(r"(?U)" + LINK_PATTERN), F.lit(1))


def netloc(url: Column) -> Column:
    """Authority part with port and user info, empty when there is no scheme."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    raw = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def cache_key(url: Column, limit: int = 120) -> Column:
    joined = F.concat_ws("-", netloc(url), path(url), query(url))
    return F.substring(slug_ascii(joined), 1, limit)
