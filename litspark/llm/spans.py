"""Problem 10: long exact spans shared between records, by MinHash bands over sliding paragraphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from litspark.llm.components import components
from litspark.sources.tables import small, written

#: Least span in code points, and the length of the k-grams hashed.
SPAN, GRAM = 300, 150
#: Paragraphs of this Jaccard similarity of k-grams are to collide with this probability; verbatim ones have 1.
SIMILARITY, RECALL = 1.0, 0.999
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 1) -> int:
    """The least number of bands of ``rows`` rows in which paragraphs of ``similarity`` collide with probability ``recall``."""
    chance = similarity**rows
    return 1 if chance >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(base, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(base)))), dtype=np.uint64)
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inverse))), dtype=np.uint64)
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(text: str, gram: int, base: int = _BASES[0]) -> np.ndarray:
    """Hash of every k-gram of the text, from differences of a prefix polynomial."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - gram + 1
    if n < 1:
        return np.empty(0, np.uint64)
    up, down = _powers(len(codes), base)
    with np.errstate(over="ignore"):
        prefix = np.concatenate(([np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        return _mixed((prefix[gram:] - prefix[:n]) * down[:n])


def _anchors(text: str, span: int, gram: int, band: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-grams that are the least of some sliding paragraph of ``span`` characters, in the order of a band."""
    h = _gram_hashes(text, gram)
    if band:
        h = _mixed(h ^ np.uint64(band * _BASES[1] & 0xFFFFFFFFFFFFFFFF))
    wide = span - gram + 1
    if len(h) < wide:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least, reach = h, 1
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    # a k-gram is an anchor if it is the least of one of the windows around it
    chosen = np.unique(least)
    at = np.flatnonzero(np.isin(h, chosen))
    return at, h[at]


def anchors(texts: DataFrame, span: int = SPAN, gram: int = GRAM, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(id, at, hash): the MinHash bands of every sliding paragraph of ``span`` characters of (id, text).

    A band is one row, the least of the paragraph's k-grams in the band's own order; neighbouring
    paragraphs share it, so that a text has few. As many bands are taken as ``similarity`` and
    ``recall`` ask for. Two texts with a common span of ``span`` characters have a whole
    paragraph in common, of similarity 1, and one band finds every such pair; more bands find
    paragraphs that are alike.
    """
    bands = bands_for(similarity, recall)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, ats, hashes = [], [], []
            for i, text in zip(b["id"], b["text"]):
                for band in range(bands):
                    at, h = _anchors(text, span, gram, band)
                    ids.append(np.full(len(at), i, dtype=np.int64))
                    ats.append(at)
                    hashes.append(h)
            if ids:
                yield pd.DataFrame(
                    {"id": np.concatenate(ids), "at": np.concatenate(ats), "hash": np.concatenate(hashes).view(np.int64)}
                )

    return texts.where(F.length("text") >= span).mapInPandas(found, "id long, at long, hash long")


def _texts(records: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    if not isinstance(records.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be a number; give records of other keys a number first")
    texts = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.where((F.length("text") >= span) & F.col("id").isNotNull())


def shared_windows(records: DataFrame, id_col: str, text_col: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, at, w1, w2, before): paragraphs of ``span`` characters that stand in more than one record, or may do.

    Candidates are the paragraphs around anchors that collide between records; ``w1, w2`` is a
    hash of 128 bits of the paragraph itself and ``before`` the code point in front of it, -1 at
    the beginning of a text. The table is written to the shared folder. Ids must be numbers.
    """
    texts = _texts(records, id_col, text_col, span)
    marked = written(anchors(texts, span, gram), "anchors")
    several = marked.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    hits = marked.join(several.select("hash"), "hash").groupBy("id").agg(F.collect_list("at").alias("ats"))
    # the texts stay where they are if the places in question are few
    hits = small(written(hits, "hits"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, text, ats in zip(b["id"], b["text"], b["ats"]):
                ats = np.asarray(ats, dtype=np.int64)
                starts = np.zeros(len(text) - span + 2, dtype=np.int32)
                np.add.at(starts, np.maximum(ats - (span - gram), 0), 1)
                np.add.at(starts, np.minimum(ats, len(text) - span) + 1, -1)
                at = np.flatnonzero(np.cumsum(starts)[:-1] > 0)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
                one, two = (_gram_hashes(text, span, base)[at].view(np.int64) for base in _BASES)
                before = np.where(at > 0, codes[np.maximum(at - 1, 0)], -1)
                yield pd.DataFrame({"id": i, "at": at, "w1": one, "w2": two, "before": before})

    found = texts.join(hits, "id").mapInPandas(windows, "id long, at long, w1 long, w2 long, before long")
    return written(found, "windows")


def span_starts(windows: DataFrame) -> DataFrame:
    """(w1, w2, id, before, at): the paragraphs at which a common span of two records begins.

    That is where the characters before it differ or a text begins; so a span of any length
    makes one row for each of its records, and records that agree inside a span meet nowhere else.
    """
    key = ["w1", "w2"]
    starts = windows.groupBy(*key, "before").agg(F.count("*").alias("n"))
    kinds = starts.groupBy(*key).agg(F.count("*").alias("kinds"), F.max(F.when(F.col("before") < 0, F.col("n"))).alias("first"))
    open_ = kinds.where("kinds > 1 or first > 1").select(*key)
    return written(windows.join(open_, key).groupBy(*key, "id", "before").agg(F.min("at").alias("at")), "begun")


def with_paragraphs(starts: DataFrame, records: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """``starts`` with the paragraph itself in place of trust in its hash: an exact check at an edit distance of 0."""
    ids = small(written(starts.select("id").distinct(), "ids"))
    texts = _texts(records, id_col, text_col, span).join(ids, "id")
    return starts.join(texts, "id").withColumn("paragraph", F.expr(f"substring(text, cast(at as int) + 1, {span})")).drop("text")


def shared_pairs(windows: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of records that have a paragraph in common.

    With ``starts`` from ``with_paragraphs`` colliding paragraphs are compared themselves, else by
    a hash of 128 bits. A paragraph of m records makes a row of each pair, as pairs are what is
    asked for; ``span_links`` has m rows.
    """
    begun = span_starts(windows) if starts is None else starts
    key = [c for c in ("w1", "w2", "paragraph") if c in begun.columns]
    begun = begun.select(*key, "id", "before")
    other = begun.select(*key, F.col("id").alias("id_b"), F.col("before").alias("other"))
    meet = (F.col("id") < F.col("id_b")) & ((F.col("before") != F.col("other")) | (F.col("before") < 0))
    return begun.join(other, key).where(meet).select(F.col("id").alias("id_a"), "id_b").distinct()


def span_links(starts: DataFrame) -> DataFrame:
    """(id, first_id): each record beside the least one with which it shares a paragraph; a hot paragraph makes one link a record."""
    key = [c for c in ("w1", "w2", "paragraph") if c in starts.columns]
    least = starts.groupBy(*key).agg(F.min("id").alias("first_id"))
    return starts.join(least, key).where("id <> first_id").select("id", "first_id").distinct()


def shared_share(records: DataFrame, windows: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(id, n_chars, shared_chars, spans, shared): how much of each record stands verbatim in another one.

    Overlapping paragraphs that other records have too are joined to spans. Records without a
    shared span have 0; null and empty texts have 0 of 0 characters and share 0.
    """
    several = windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    common = windows.join(several, ["w1", "w2"]).select("id", "at")
    by_text = Window.partitionBy("id").orderBy("at")
    new = F.col("at") - F.lag("at", 1, -(10**9)).over(by_text)
    grown = common.select("id", F.least(new, F.lit(span)).alias("chars"), (new > span).cast("int").alias("opens"))
    parts = grown.groupBy("id").agg(F.sum("chars").alias("shared_chars"), F.sum("opens").alias("spans"))
    whole = records.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"))
    out = whole.join(parts, "id", "left").fillna(0, ["shared_chars", "spans"])
    return out.withColumn("shared", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))


def removal_clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): records joined by shared spans, also by way of others, under their least id; of pairs or links."""
    a, b = pairs.columns[:2]
    return components(pairs, a, b).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
