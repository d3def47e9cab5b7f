"""Documents cut into overlapping passages, and their places in pages and sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters of a passage and of the overlap, the share after which it may end at a
# sentence, and the marks that end one, the first found in this order being taken.
SIZE, OVERLAP, BREAK_AFTER = 1600, 400, 0.8
BREAKS = (". ", ".\n", "? ", "?\n", "! ", "!\n")


def offsets(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each passage that is not blank; passages overlap, and each begins after the one before."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            ends = (text.rfind(mark, start + int(size * BREAK_AFTER), end) + len(mark) for mark in BREAKS)
            end = next((e for e, mark in zip(ends, BREAKS) if e >= len(mark)), end)
        if text[start:end].strip():
            out.append((start, end))
        start = end - overlap if end - overlap > start else end
    return out


def passages(documents: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, idx, char_start, char_end, text) of all passages; text is trimmed, offsets are not.

    Each step depends on the one before, so a document is cut in one Python loop of a step for each
    passage; documents are spread by Spark. Null and blank texts give no passage.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k, s, e, t[s:e].strip()) for i, t in zip(b["id"], b["text"]) for k, (s, e) in enumerate(offsets(t, size, overlap))]
            yield pd.DataFrame(out, columns=["id", "idx", "char_start", "char_end", "text"])

    return rows.mapInPandas(cut, f"id {kind}, idx long, char_start long, char_end long, text string")


def page_starts(pages: DataFrame, doc: str, page_num: str, text_col: str) -> DataFrame:
    """(doc, page_num, char_start): where each page begins when a document's pages are joined by one line break."""
    w = Window.partitionBy(doc).orderBy(page_num).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 1).over(w), F.lit(0))
    return pages.select(F.col(doc).alias("doc"), F.col(page_num).alias("page_num"), start.alias("char_start"))


def page_of(points: DataFrame, starts: DataFrame) -> DataFrame:
    """Points (doc, at, ..) with ``page_num`` of the last page that begins at or before them, 1 where none does.

    An as-of join without a range join: the pages of a document, a short list, are gathered once
    and looked up in order.
    """
    pages = starts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("char_start", "page_num"))).alias("pages"))
    last = F.element_at(F.filter("pages", lambda p: p["char_start"] <= F.col("at")), -1)
    out = points.join(pages, "doc", "left")
    hit = F.coalesce(F.when(F.exists("pages", lambda p: p["char_start"] <= F.col("at")), last["page_num"]), F.lit(1))
    return out.withColumn("page_num", hit).drop("pages")


def section_of(at: Column, spans: Column) -> tuple[Column, Column]:
    """(label, confidence) of the first half-open span that holds the position, else ("unknown", 0.5)."""
    hit = F.get(F.filter(spans, lambda s: (s["char_start"] <= at) & (at < s["char_end"])), F.lit(0))
    return F.coalesce(hit["label"], F.lit("unknown")), F.coalesce(hit["confidence"], F.lit(0.5))


def spans(headings: DataFrame, length: str = "n_chars") -> DataFrame:
    """(doc, label, char_start, char_end) of headings (doc, at, label, n_chars): each reaches to the next one.

    A first heading after the beginning leaves a "preamble" before it.
    """
    w = Window.partitionBy("doc").orderBy("at", "label")
    own = headings.select("doc", "label", F.col("at").alias("char_start"), F.coalesce(F.lead("at").over(w), F.col(length)).alias("char_end"))
    first = headings.groupBy("doc").agg(F.min("at").alias("at")).where("at > 0")
    return own.unionByName(first.select("doc", F.lit("preamble").alias("label"), F.lit(0).cast("long").alias("char_start"), F.col("at").alias("char_end")))
