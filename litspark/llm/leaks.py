"""Problem 8: evaluation texts in a corpus, by SimHash windows and multi-index Hamming blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.sources.tables import small, written

#: Words of a window. Every passage of 12 words with one in eight replaced has two or more windows of five unchanged words;
#: windows as long as an item would be up to 20 of 64 bits apart.
WINDOW = 5
#: Hamming distance of fingerprints; one more block than this makes sure that one block is equal.
RADIUS, BLOCKS = 3, 4
#: Least words of a passage, and the words of which one may be replaced.
LEAST, ONE_IN = 12, 8
#: Weighted similarity from which a passage is the item's. Weights are between 1 and 2, so that one word in eight replaced leaves more.
SIMILAR = 0.77


def _words(text: str) -> list[str]:
    """Words in lower case without punctuation; parts between white space are words."""
    return [w for w in ("".join(filter(str.isalnum, part)) for part in text.lower().split()) if w]


def fingerprints(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, at, print): the 64-bit SimHash of each window of ``window`` words of (id, text).

    A bit is set if most words of the window have it in their hash. Texts of fewer words and
    null texts give no row.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, lengths = [], []
            for text in b["text"]:
                own = _words(text)
                words += own
                lengths.append(len(own))
            if len(words) < window:
                continue
            codes, names = pd.factorize(np.array(words, dtype=object))
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], dtype=np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
            rows = bits[codes]
            n = len(words) - window + 1
            votes = np.zeros((n, 64), dtype=np.int16)
            for k in range(window):
                votes += rows[k : k + n]
            prints = np.packbits(votes * 2 > window, axis=1).reshape(-1, 8).copy().view(np.int64).ravel()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            inside = owner[:n] == owner[window - 1 :]
            starts = np.cumsum([0, *lengths[:-1]])
            at = np.arange(n) - starts[owner[:n]]
            ids = b["id"].to_numpy()[owner[:n]]
            yield pd.DataFrame({"id": ids[inside], "at": at[inside], "print": prints[inside]})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.where("text is not null").mapInPandas(found, f"id {kind}, at long, print long")


def _blocks(prints: DataFrame, name: str = "print") -> DataFrame:
    """A row for each block of 16 bits of each fingerprint."""
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(name, 16 * k).bitwiseAND(0xFFFF).alias("bits")) for k in range(BLOCKS)]
    return prints.withColumn("b", F.explode(F.array(*blocks))).select("*", "b.block", "b.bits").drop("b")


def _passage(own: list[str], asked: list[str], shift: int, weights: np.ndarray) -> tuple[int, int, float] | None:
    """(first word of the item, words, weighted similarity) of the longest passage on a diagonal, or None.

    Shingles are words in their places: the similarity is the weight of those that agree in the weight of all.
    """
    low, high = max(0, -shift), min(len(asked), len(own) - shift)
    same = np.array([asked[k] == own[k + shift] for k in range(low, high)], dtype=bool)
    at = np.flatnonzero(same)
    if len(at) < 2:
        return None
    missed, weight = np.append(0, np.cumsum(~same)), np.append(0.0, np.cumsum(weights[low:high]))
    agreed = np.append(0.0, np.cumsum(np.where(same, weights[low:high], 0.0)))
    best = None
    for a in at.tolist():
        ends = at[at >= a + max(LEAST, best[1] + 1 if best else 0) - 1]
        if not len(ends):
            continue
        similar = (agreed[ends + 1] - agreed[a]) / (weight[ends + 1] - weight[a])
        good = (similar >= SIMILAR) & ((missed[ends + 1] - missed[a]) * ONE_IN <= ends - a + 1)
        if good.any():
            end = int(np.flatnonzero(good)[-1])
            best = (low + a, int(ends[end]) - a + 1, float(similar[end]))
    return best


def _item_words(items: DataFrame) -> DataFrame:
    """(item_id, words, weights): the words of each item, and their weights from 1 (in all items) to 2 (in one)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "words": [_words(t) for t in b["item_text"]]})

    kind = items.schema["item_id"].dataType.simpleString()
    cut_items = written(items.mapInPandas(cut, f"item_id {kind}, words array<string>").where("size(words) > 0"), "item_words")
    total = cut_items.count()
    known = cut_items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    weight = 1 + F.log1p(F.lit(float(total)) / F.col("n")) / F.log1p(F.lit(float(max(1, total))))
    each = cut_items.select("item_id", F.posexplode("words").alias("at", "word")).join(known, "word")
    each = each.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "word", F.least(weight, F.lit(2.0)).alias("weight")))).alias("w"))
    return written(each.select("item_id", F.col("w.word").alias("words"), F.col("w.weight").alias("weights")), "items")


def find_leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """(id, item_id, at, words, similarity): the passages of items that documents hold.

    All windows of all documents are looked up in the index of the items' windows: fingerprints
    within RADIUS agree in one of the blocks. A diagonal of a document and an item that two
    windows hit, as those of every passage are, is verified: the exact weighted similarity
    of the words in their places must reach SIMILAR, over at least LEAST words in order, without
    gaps, at most one in ONE_IN replaced. One row for each document and item, with the longest
    passage (ties: the first). Null and short texts hold none; repeated documents are reported
    each; of repeated item ids the first text in order counts.
    """
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_text is not null and item_id is not null")
    items = written(items.groupBy("item_id").agg(F.min("item_text").alias("item_text")), "asked")
    asked = fingerprints(items.select(F.col("item_id").alias("id"), F.col("item_text").alias("text")))
    index = _blocks(asked.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("print").alias("item_print")), "item_print")
    index = small(written(index, "index"))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    hits = _blocks(fingerprints(texts)).join(index, ["block", "bits"]).where(near)
    hits = hits.groupBy("id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    # the first and the last place of the windows that hit
    hits = hits.agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low < high").select("id", "item_id", "shift")
    diagonals = written(hits, "diagonals")
    pairs = written(diagonals.join(small(_item_words(items)), "item_id"), "pairs")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, []
        for b in batches:
            out = []
            for i, text, item, asked, weights, shift in zip(b["id"], b["text"], b["item_id"], b["words"], b["weights"], b["shift"]):
                if text is not last:
                    last, own = text, _words(text)
                passage = _passage(own, list(asked), int(shift), np.asarray(weights))
                if passage:
                    out.append((i, item, passage[0] + int(shift), passage[1], passage[2]))
            yield pd.DataFrame(out, columns=["id", "item_id", "at", "words", "similarity"])

    kind = {c: f"{c} {x.schema[c].dataType.simpleString()}" for c, x in (("id", texts), ("item_id", items))}
    schema = f"{kind['id']}, {kind['item_id']}, at long, words long, similarity double"
    # the texts stay where they are if what hit them is small
    found = texts.join(small(pairs), "id").select("id", "text", "item_id", "words", "weights", "shift").mapInPandas(verified, schema)
    best = F.max(F.struct("words", (-F.col("at")).alias("early"), "similarity")).alias("best")
    return found.groupBy("id", "item_id").agg(best).select(
        "id", "item_id", (-F.col("best.early")).alias("at"), "best.words", "best.similarity"
    )
