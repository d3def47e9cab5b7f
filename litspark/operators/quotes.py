"""Quotes found again on pages: one form for both, and the place of a quote."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from litspark.sources.tables import written

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Least characters of a quote that can be placed.
LEAST = 12
#: Bits of the filter of beginnings, at most (16 MB) and for each beginning; bytes of text that are looked at together.
MOST_BITS, BITS, PIECE = 1 << 27, 32, 1 << 20
# Odd factors of the hash of bytes.
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def without_ligatures(text: Column) -> Column:
    for one, letters in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(letters))
    return text


def with_ligatures(text: Column) -> Column:
    """The text with its ligatures set again, the longest first."""
    for one, letters in sorted(LIGATURES.items(), key=lambda x: -len(x[1])):
        text = F.replace(text, F.lit(letters), F.lit(one))
    return text


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """The compatibility form of Unicode, which is the one step without an expression."""
    return text.str.normalize("NFKC")


def plain_quote(text: Column) -> Column:
    """A text in the form in which quotes and pages are compared: words broken at lines joined, marks of markdown dropped, one kind of quotation mark and dash, single blanks, none beside marks.

    The form of a form is itself. Null is empty.
    """
    out = F.regexp_replace(compatible(F.coalesce(text, F.lit(""))), r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")
    out = F.regexp_replace(out, r"^\s*(#{1,6}\s+|[-*+]\s+|[0-9]+[.)]\s+)", "")
    out = F.regexp_replace(out, r"`+|(?<![0-9A-Za-z])[*_]+|[*_]+(?![0-9A-Za-z])", "")
    out = F.translate(out, "‘’‚‛“”„‟–—−", "''''\"\"\"\"---")
    out = F.trim(F.regexp_replace(without_ligatures(out), r"[\s\p{Z}]+", " "))
    return F.regexp_replace(F.regexp_replace(out, r" ([,.;:!?%)\]}])", "$1"), r"([(\[{]) ", "$1")


def _begun(n: int) -> int:
    """The length of the beginning that stands for ``n`` bytes: the largest 2^k or 3 * 2^k of no more than these."""
    whole = 1 << (n.bit_length() - 1)
    return whole * 3 // 2 if whole > 1 and n >= whole * 3 // 2 else whole


def _hashes(data: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, the smallest first, the hashes of as many bytes from each place on; two overlapping powers of two make a size."""
    hashes, length, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    for size in sizes:
        while 2 * length <= size:
            hashes = hashes[:-length] * np.uint64(power) + hashes[length:]
            length, power = 2 * length, power * power % (1 << 64)
        n = max(len(data) - size + 1, 0)
        yield size, hashes[:n] * np.uint64(_SPREAD) + hashes[size - length : size - length + n]


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of so many bits, a power of two."""
    spread = hashes * np.uint64(_BASE)
    return (spread >> np.uint64(37)) & np.uint64(bits - 1), (spread >> np.uint64(10)) & np.uint64(bits - 1)


@F.pandas_udf(StructType().add("size", IntegerType()).add("key", LongType()))
def _begins(quote: pd.Series, doc: pd.Series) -> pd.DataFrame:
    """The length of a quote's beginning, and the hash of it and of the document."""
    texts = [q.encode() for q in quote]
    sizes = [_begun(len(t)) for t in texts]
    first = np.array([next(_hashes(np.frombuffer(t[:n], np.uint8), [n]))[1][0] for t, n in zip(texts, sizes)], np.uint64)
    return pd.DataFrame({"size": sizes, "key": (first ^ doc.to_numpy(np.int64).view(np.uint64)).view(np.int64)})


def _filter(begins: DataFrame, n: int) -> np.ndarray:
    """A filter (Bloom) of the keys, in words of 64 bits."""
    bits = 1 << min(max(n * BITS - 1, 1023).bit_length(), MOST_BITS.bit_length() - 1)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slots = np.sort(np.concatenate(_slots(b["key"].to_numpy(np.int64).view(np.uint64), bits)))
            if len(slots):
                word, first = np.unique(slots >> np.uint64(6), return_index=True)
                mask = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first)
                yield pd.DataFrame({"word": word.astype(np.int64), "mask": mask.view(np.int64)})

    rows = begins.select("key").mapInPandas(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return out


def _places(pages: DataFrame, sizes: list[int], passing: np.ndarray) -> DataFrame:
    """(doc, page, at, key, tail): the places on pages whose bytes pass the filter, with the bytes that a quote of that beginning may take."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("doc", "page")}
    bits = len(passing) << 6
    after = {n: next(m for m in range(n + 1, 2 * n + 2) if _begun(m) > n) - 1 for n in sizes}

    def passes(slot: np.ndarray) -> np.ndarray:
        return (passing[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            whole, docs, low = texts.buffers()[2], b.column("hash").to_numpy(zero_copy_only=False).view(np.uint64), 0
            while low < len(b):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
                bounds = offsets[low : high + 1] - offsets[low]
                piece = bytes(whole[offsets[low] : offsets[high]]) if bounds[-1] else b""
                of_doc = np.repeat(docs[low:high], np.diff(bounds))
                for size, hashes in _hashes(np.frombuffer(piece, np.uint8), sizes):
                    keys = hashes ^ of_doc[: len(hashes)]
                    one, two = _slots(keys, bits)
                    at = np.nonzero(passes(one))[0]
                    at = at[passes(two[at])]
                    row = np.searchsorted(bounds, at, "right") - 1
                    whole_in_row = at + size <= bounds[row + 1]
                    at, row = at[whole_in_row], row[whole_in_row]
                    ends = np.minimum(at + after[size], bounds[row + 1])
                    rows = pa.array(row + low)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc").take(rows), b.column("page").take(rows), pa.array(at - bounds[row]), pa.array(keys[at].view(np.int64)),
                         pa.array([piece[x:y] for x, y in zip(at, ends)], pa.binary())], ["doc", "page", "at", "key", "tail"]
                    )
                low = high

    rows = pages.where("text is not null and doc is not null").select("doc", "page", "text", F.xxhash64(F.col("doc").cast("string")).alias("hash"))
    return rows.mapInArrow(look, f"doc {kinds['doc']}, page {kinds['page']}, at long, key long, tail binary")


def found(quotes: DataFrame, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, quote, page, twice): the pages of a document on which each of its distinct quotes stands, and whether more than once.

    A quote is looked for by its beginning: a filter of these goes to the tasks, and only the places
    of the pages that pass it are joined with the quotes and compared in full, so that the work
    grows with the texts, not with quotes times pages of a document. The filter bounds its own
    size; if it is too full for very many quotes, more places are joined and none is lost.
    """
    asked = quotes.where((F.length("quote") >= least) & (F.length("quote") > 0) & F.col("doc").isNotNull()).select("doc", "quote").distinct()
    begins = F.col("b.size").alias("size"), F.col("b.key").alias("key")
    asked = asked.withColumn("b", _begins("quote", F.xxhash64(F.col("doc").cast("string")))).select("doc", "quote", *begins)
    asked = written(asked, "quotes")
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())
    places = _places(pages, sizes, _filter(asked, asked.count()))
    met = places.join(asked.drop("size"), ["key", "doc"]).where(F.startswith("tail", F.col("quote").cast("binary")))
    return met.groupBy("doc", "quote", "page").agg((F.max("at") - F.min("at") >= F.octet_length("quote")).alias("twice"))


def placed(quotes: DataFrame, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(quote_id, page, state) of quotes (quote_id, doc, quote, hint) on pages (doc, page, text), all in their plain form.

    The hinted page comes first, then the others in order; state is placed, ambiguous (it stands
    more than once on the page), short or missing. Each page is one row.
    """
    asked = quotes.withColumn("short", F.length("quote") < least)
    on_pages = written(found(quotes, pages, least), "found")
    first = on_pages.groupBy("doc", "quote").agg(F.min_by(F.struct("page", "twice"), "page").alias("p"))
    hinted = on_pages.select("doc", "quote", F.col("page").alias("hint"), F.struct("page", "twice").alias("p"))
    met = asked.join(first, ["doc", "quote"]).select("quote_id", "hint", "p").unionByName(asked.join(hinted, ["doc", "quote", "hint"]).select("quote_id", "hint", "p"))
    best = met.groupBy("quote_id").agg(F.min_by("p", F.struct((F.col("p.page") != F.col("hint")).alias("other"), "p.page")).alias("p"))
    state = F.when(F.col("short"), "short").when(F.col("p").isNull(), "missing").when(F.col("p.twice"), "ambiguous").otherwise("placed")
    return asked.join(best, "quote_id", "left").select("quote_id", F.col("p.page").alias("page"), state.alias("state"))


def coverage(quotes: DataFrame, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(state, n): how many quotes are short, found and missing; which page it is doesn't matter here."""
    met = found(quotes, pages, least).select("doc", "quote").distinct().withColumn("met", F.lit(True))
    state = F.when(F.length("quote") < least, "short").when(F.col("met"), "found").otherwise("missing")
    return quotes.join(met, ["doc", "quote"], "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
