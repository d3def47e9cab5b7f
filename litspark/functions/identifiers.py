"""Identifiers and addresses as the library writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doi(text: Column) -> Column:
    """Lower case, trimmed, without a resolver's address and "doi:" at the beginning; null where nothing is left."""
    out = F.regexp_replace(F.lower(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    out = F.regexp_replace(out, r"^https?://(dx\.)?doi\.[a-z]+/", "")
    return F.nullif(F.regexp_replace(out, r"^doi:[\s\p{Z}]*", ""), F.lit(""))


def is_doi(text: Column) -> Column:
    """Whether the text is a DOI: 10., four digits or more, a slash, and a name without blanks."""
    return F.coalesce(text.rlike(r"^10\.[0-9]{4,}/\S+$"), F.lit(False))


def arxiv(text: Column) -> Column:
    """The id without prefix and version, in lower case; null where nothing is left."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"^(arxiv:\s*|https?://(www\.)?arxiv\.[a-z]+/(abs|pdf)/)", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(out, r"\.pdf$", ""), r"v[0-9]+$", ""), F.lit(""))


def host(url: Column) -> Column:
    """The host of an address without "www.", in lower case."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """An address without query, fragment and closing slash, its host in lower case."""
    plain = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    start = F.regexp_extract(plain, r"^([a-zA-Z]+://[^/]*)", 1)
    return F.concat(F.lower(start), F.substr(plain, F.length(start) + 1))


def title_key(title: Column) -> Column:
    """The words of a title in lower case, other characters as one blank."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def venue_key(name: Column) -> Column:
    """A venue's name in lower case with separators as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[&:\-/]", " "), r"[\s\p{Z}]+", " "))
