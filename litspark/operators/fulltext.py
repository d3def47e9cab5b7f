"""Word index of documents, and boolean search over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.sources.tables import written

#: Rows of a block of either side whose words are counted together, pairs that leave it at a time, and tasks at most.
ASKED, ROWS, PAIRS, TASKS = 4096, 1 << 16, 1 << 18, 10_000


def postings(documents: DataFrame, id_col: str, text_col: str, wanted: list[str] | None = None) -> DataFrame:
    """(id, word): the distinct lower-case words of each document, split at white space; only the ``wanted`` ones leave the texts, if given."""
    words = F.array_distinct(F.split(F.lower(F.col(text_col)), r"\s+"))
    if wanted is not None:
        words = F.array_intersect(words, F.array(*[F.lit(w.lower()) for w in wanted]))
    return documents.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).where("word <> ''")


def any_word(index: DataFrame, words: list[str]) -> DataFrame:
    """(id, hits): documents with at least one of the words; repeated words count once."""
    wanted = sorted({w.lower() for w in words})
    return index.where(F.col("word").isin(wanted)).groupBy("id").agg(F.count_distinct("word").alias("hits"))


def all_words(index: DataFrame, words: list[str]) -> DataFrame:
    """(id): documents with all the words, by relational division."""
    wanted = sorted({w.lower() for w in words})
    return any_word(index, wanted).where(F.col("hits") == len(wanted)).select("id")


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, least: int) -> DataFrame:
    """(left_id, right_id, overlap): all pairs of rows with ``least`` distinct words in common; ids are distinct.

    Blocks of left rows meet blocks of right rows in the tasks, where the right rows of each word of a
    left row are counted up. The result grows with both sides, and so does the work, by some
    nanoseconds a pair.
    """
    left, right = numbered(left, right, left_id, right_id, words, least)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((left, left_id), (right, right_id))]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q_ids, counts in _counted(batches):
            out, n = [], 0

            def batch(out: list, ids: pa.Array = ids, q_ids: pa.Array = q_ids) -> pa.RecordBatch:
                q, places, common = zip(*out)
                ends = np.cumsum([0, *map(len, places)])
                met = pa.StructArray.from_arrays([ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(common).astype(np.int64))], ["id", "overlap"])
                return pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), met)], ["q", "met"])

            for q, hits in counts:
                places = np.flatnonzero(hits >= least)
                if len(places):
                    out.append((q, places, hits[places]))
                    n += len(places)
                if n > PAIRS:
                    yield batch(out)
                    out, n = [], 0
            if out:
                yield batch(out)

    met = _met(left, right, left_id, right_id, words).mapInArrow(pairs, f"q {kinds[0]}, met array<struct<id: {kinds[1]}, overlap: long>>")
    return met.select(F.col("q").alias(left_id), F.inline("met")).withColumnRenamed("id", right_id)


def _packed(rows: DataFrame, key: str, words: str, size: int) -> DataFrame:
    """(ids, sizes, numbers): up to ``size`` rows of (key, words as numbers) as one row."""
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), size):
                part = b.slice(at, size)
                lists = part.column("w")
                sizes, numbers = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pa.ListArray.from_arrays([0, len(part)], part.column("id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([sizes.tobytes()], pa.binary()), pa.array([numbers.tobytes()], pa.binary())], ["ids", "sizes", "numbers"])

    return rows.select(F.col(key).alias("id"), F.col(words).alias("w")).mapInArrow(pack, f"ids array<{kind}>, sizes binary, numbers binary")


def numbered(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Both sides as (id, words) with the words that both have as numbers; rows with fewer than ``least`` of these are left out."""
    of = lambda df: df.select(F.explode(words).alias("w")).distinct()
    both = written(written(of(left).join(of(right), "w"), "words").withColumn("n", F.monotonically_increasing_id()), "words")

    def side(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(key, F.explode(words).alias("w")).join(both, "w").groupBy(key).agg(F.collect_set("n").alias(words))
        return rows.where(F.size(words) >= least)

    return side(left, left_id), side(right, right_id)


def _met(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str) -> DataFrame:
    """Every block of left rows (q_ids, q_sizes, q_numbers) with every block of right ones, in up to TASKS tasks."""
    left, right = written(_packed(left, left_id, words, ASKED), "asked"), written(_packed(right, right_id, words, ROWS), "rows")
    left = left.withColumnsRenamed({c: f"q_{c}" for c in left.columns})
    return right.crossJoin(left).repartition(min(max(right.count() * left.count(), 1), TASKS))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, Iterator[tuple[int, np.ndarray]]]]:
    """(right ids, left ids, counts) of each pair of blocks; counts are (place of a left row, its words in common with each right row), in one array that is used again."""
    for b in batches:
        for k in range(len(b)):
            ids, sizes, numbers, q_ids, q_sizes, q_numbers = (b.column(c)[k] for c in ("ids", "sizes", "numbers", "q_ids", "q_sizes", "q_numbers"))
            sizes, q_sizes = (np.frombuffer(x.as_py(), np.int32) for x in (sizes, q_sizes))
            numbers, q_numbers = (np.frombuffer(x.as_py(), np.int64) for x in (numbers, q_numbers))
            at = np.argsort(numbers, kind="stable")
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            low, high = (np.searchsorted(numbers[at], q_numbers, side) for side in ("left", "right"))

            def counts(row=row, low=low, high=high, sizes=sizes, q_sizes=q_sizes) -> Iterator[tuple[int, np.ndarray]]:
                ends, hits = np.cumsum(q_sizes), np.zeros(len(sizes), np.uint8 if q_sizes.max() < 256 else np.int32)
                for q, (start, end) in enumerate(zip(ends - q_sizes, ends)):
                    hits[:] = 0
                    for j in range(start, end):
                        hits[row[low[j] : high[j]]] += 1
                    yield q, hits

            yield ids.values, q_ids.values, counts()


def clear_best(asked: DataFrame, rows: DataFrame, asked_id: str, row_id: str, words: str, least: int, times: float) -> DataFrame:
    """(asked_id, row_id, overlap): for each asked row the one row with most words in common, if these are ``least`` and ``times`` as many as the next row has.

    Words are distinct. Equal lists of words are asked once. Blocks of asked lists meet blocks of
    rows in the tasks; there the rows of each word of a list are counted up, and the first two counts
    of a block are all that leaves it. That counts every pair, at some nanoseconds each.
    """
    asked, rows = numbered(asked, rows, asked_id, row_id, words, least=1)
    asked = written(asked.withColumn(words, F.sort_array(words)), "asked")
    lists = written(asked.where(F.size(words) >= least).select(words).distinct().select(F.monotonically_increasing_id().alias("list"), words), "lists")
    met = _met(lists, rows, "list", row_id, words)
    kind = rows.schema[row_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q_ids, counts in _counted(batches):
            out = []
            for q, hits in counts:
                best = int(hits.argmax())
                most, hits[best] = int(hits[best]), 0
                if most:
                    out.append((q, best, most, int(hits.max())))
            if out:
                q, best, most, after = (pa.array(np.array(x)) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([q_ids.take(q), ids.take(best), most, after], ["list", "id", "most", "after"])

    met = met.mapInArrow(count, f"list long, id {kind}, most long, after long")
    best = met.groupBy("list").agg(F.max(F.struct("most", "id")).alias("first"), F.sort_array(F.flatten(F.collect_list(F.array("most", "after"))), False).alias("all"))
    clear = best.where((F.col("first.most") >= least) & (F.col("first.most") >= times * F.col("all")[1]))
    clear = clear.join(lists, "list").select(words, F.col("first.id").alias(row_id), F.col("first.most").alias("overlap"))
    return asked.join(clear, words).select(asked_id, row_id, "overlap")
