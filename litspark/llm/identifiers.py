"""Canonical forms of DOIs, arXiv ids and whole records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters without width, and dashes that stand for the hyphen.
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63"


def plain(text: Column) -> Column:
    """Lower case without white space and zero-width characters; full-width forms and dashes as ASCII."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    clean = F.translate(text, wide + DASHES + ZERO_WIDTH, narrow + "-" * len(DASHES))
    clean = F.regexp_replace(F.lower(clean), r"[\s\p{Z}\p{Cf}]+", "")
    clean = F.when(
        clean.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(clean, r"\+", "%2B")), clean)
    ).otherwise(clean)
    # most values are visible ASCII and need none of it
    return F.when(text.rlike(r"^[!-$&-~]*$"), F.lower(text)).otherwise(clean)


def arxiv_id(text: Column) -> Column:
    """The arXiv id named in a plain text, without version and subject class; null if there is none."""
    bare, text = text, F.regexp_replace(text, r"\.pdf$", "")
    new = F.regexp_extract(text, r"(?:^|[^0-9.])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?![0-9])", 1)
    old = F.regexp_extract(text, r"([a-z]+(?:-[a-z]+)?(?:\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?(?![0-9])", 1)
    found = F.when(new != "", new).when(old != "", F.regexp_replace(old, r"\.[a-z]{2}/", "/"))
    return F.when(bare.rlike(r"^[0-9]{4}\.[0-9]{4,5}$"), bare).otherwise(found)


def doi(text: Column) -> Column:
    """The DOI named in a plain text, without resolver, query, and closing marks; null if incomplete."""
    name = F.regexp_extract(text, r"(10\.[0-9]{4,9}(?:\.[0-9]+)*/[^?#\"<>]*)", 1)
    name = F.regexp_replace(name, r"&(?:gt|lt|quot);?$", "")
    name = F.regexp_replace(name, r"[\s.,;:!'’”\]}/\\|]+$", "")
    # a closing bracket belongs to the DOI only if one opens in it
    name = F.regexp_replace(name, r"^([^(]*?)[\s.,;:!'’”\]}/\\|)]+$", "$1")
    found = F.when(name.rlike(r"^10\.[0-9.]+/.*[0-9a-z]"), name)
    return F.when(text.rlike(r"^10\.[0-9]{4,9}/[0-9a-z._/-]*[0-9a-z]$"), text).otherwise(found)


def with_identifier_keys(df: DataFrame, out: str, *columns: str) -> DataFrame:
    """``df`` with ``out``, an array of the distinct keys that the columns name.

    A key is ``d:`` + DOI or ``a:`` + arXiv id. A DOI issued by arXiv stands for the arXiv id; a
    column that holds the other kind of identifier is read as what it is. Null, blank and
    incomplete values give no key. The steps are columns of their own, so that a value is
    brought to its plain form once.
    """
    names = []
    for k, column in enumerate(columns):
        p, n = f"_plain_{k}", f"_doi_{k}"
        df = df.withColumn(p, plain(F.col(column))).withColumn(n, doi(F.col(p)))
        own = F.col(n).startswith("10.48550/arxiv.")
        df = df.withColumn(
            f"_key_{k}",
            F.when(own, F.concat(F.lit("a:"), arxiv_id(F.regexp_replace(n, r"^10\.48550/arxiv\.", ""))))
            .when(F.col(n).isNotNull(), F.concat(F.lit("d:"), F.col(n)))
            .otherwise(F.concat(F.lit("a:"), arxiv_id(F.col(p)))),
        )
        names += [p, n, f"_key_{k}"]
    keys = F.array_distinct(F.array_compact(F.array(*[F.col(f"_key_{k}") for k in range(len(columns))])))
    return df.withColumn(out, keys).drop(*names)


def record_key(*fields: Column) -> Column:
    """One key for records equal but for case, white space, punctuation and the order of their fields."""
    plain_fields = [
        F.regexp_replace(F.lower(F.coalesce(f.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", "") for f in fields
    ]
    return F.array_join(F.array_sort(F.array(*plain_fields)), "\u001f")
