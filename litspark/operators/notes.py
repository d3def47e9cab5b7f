"""Notes and feeds: search, merging of two sources, lists with counts, and notes as HTML."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def escaped(text: Column) -> Column:
    """Text with the marks of HTML written out; the ampersand comes first."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def paragraphs(text: Column, title: Column | None = None) -> Column:
    """Text as paragraphs of HTML: blank lines part them, single line breaks are kept as breaks; a title comes first. Null is empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(escaped(p), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))), "")
    if title is None:
        return body
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("<h1>"), escaped(title), F.lit("</h1>"))).otherwise("")
    return F.concat(head, body)


@F.pandas_udf(StringType())
def plain_text(markup: pd.Series) -> pd.Series:
    """The text nodes of HTML with entities decoded, trimmed; null is null."""
    bare = markup.str.replace(r"<(?:!--.*?--|[/!?]?[a-zA-Z][^<>]*)>", "", regex=True, flags=16)
    return bare.map(lambda t: html.unescape(t).strip(), na_action="ignore")


def newest(notes: DataFrame, most: int, when: str = "added_at", key: str = "doc_id") -> DataFrame:
    """The newest ``most`` rows with ``position``; the last first of equal times by key."""
    order = [F.desc(when), F.col(key)]
    return notes.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def notes_search(notes: DataFrame, needle: str, most: int, text: str = "text") -> DataFrame:
    """The newest notes whose raw content holds a text, whatever the case."""
    return newest(notes.where(F.contains(F.lower(text), F.lit(needle.lower()))), most)


def merged(left: DataFrame, right: DataFrame, key: str, columns: list[str], left_name: str, right_name: str) -> DataFrame:
    """(key, columns, origin): rows of both sources by key; where both have one, the right row wins whole.

    Of repeated keys in a source the greatest row in order counts; null keys are left out.
    """
    one = lambda df, rank, name: df.where(F.col(key).isNotNull()).select(key, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("origin"), *columns).alias("r"))
    both = one(left, 0, left_name).unionByName(one(right, 1, right_name))
    return both.groupBy(key).agg(F.max("r").alias("r")).select(key, *[F.col(f"r.{c}") for c in columns], "r.origin")


def counted(groups: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Each group with the number of its members, 0 for none."""
    n = members.groupBy(key).agg(F.count("*").alias("items"))
    return groups.join(n, key, "left").withColumn("items", F.coalesce("items", F.lit(0)))


def newest_of_each(rows: DataFrame, group: str, when: str, key: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each group with ``position``; the row limit of a group is taken in each task before groups meet."""
    w = Window.partitionBy(group).orderBy(F.desc(when), F.col(key))
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
