"""Nearest neighbours, re-ranking, topics, and passages around a hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.sources.tables import small, written

#: Vectors of a block.
BLOCK = 2048
# Weights of sections and venue quartiles, and what unknown ones weigh.
SECTION_WEIGHTS = {
    "results": 1.0, "conclusion": 1.0, "table": 0.9, "figure": 0.85, "formula": 0.85, "methods": 0.85, "unknown": 0.85, "abstract": 0.75,
    "background": 0.7, "discussion": 0.65, "introduction": 0.5, "preamble": 0.3, "appendix": 0.3, "references": 0.1,
}
QUARTILE_WEIGHTS = {"Q1": 1.0, "Q2": 0.85, "Q3": 0.65, "Q4": 0.45}
OTHER, ALPHA = 0.7, 0.7


def _packed(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(ids, matrix): the unit vectors of up to ``size`` rows as one row of bytes."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and id is not null")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), size):
                v = np.stack(b["v"].to_numpy()[at : at + size])
                norms = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"ids": [b["id"].to_numpy()[at : at + size]], "matrix": [(v / np.where(norms > 0, norms, 1)).tobytes()]})

    return rows.mapInPandas(pack, f"ids array<{kind}>, matrix binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): for each query the k rows of highest cosine, itself included.

    Rows and queries are packed in blocks, and every block of rows meets every block of queries
    in the tasks, where the k best of each query are kept; the queries are broadcast if they are
    small. Scores are rounded to 6 digits, ties go to the smaller id. Null vectors have no score;
    a vector of zeros has score 0; repeated ids are rows of their own.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    asked = written(_packed(queries, id_col, vector_col, BLOCK), "queries").withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, matrix, q_ids, q_matrix in zip(b["ids"], b["matrix"], b["q_ids"], b["q_matrix"]):
                at = np.argsort(ids, kind="stable")
                v, q = (np.frombuffer(m).reshape(len(i), -1) for i, m in ((ids, matrix), (q_ids, q_matrix)))
                s = np.round(q @ v[at].T, 6)
                n = min(k, s.shape[1])
                # all that reach the n-th score, of which the first n by score and id stay
                least = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
                query, place = np.nonzero(s >= least)
                order = np.lexsort((place, -s[query, place], query))
                query, place = query[order], place[order]
                first = np.arange(len(query)) - np.searchsorted(query, query) < n
                query, place = query[first], place[first]
                yield pd.DataFrame({"query_id": np.asarray(q_ids)[query], "id": np.asarray(ids)[at][place], "score": s[query, place]})

    met = _packed(vectors, id_col, vector_col, BLOCK).crossJoin(small(asked))
    out = met.mapInPandas(best, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _weight(name: Column, weights: dict[str, float], missing: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.when(name.isNull() | (name == ""), F.lit(missing)).otherwise(F.coalesce(F.try_element_at(table, name), F.lit(OTHER)))


def rerank(
    hits: DataFrame, sections: dict[str, float] | None = None, quartiles: dict[str, float] | None = None, alpha: float = ALPHA
) -> DataFrame:
    """Hits (.., score, section, quartile) with ``composite`` = max(score, 0)^alpha x weights, where it is over 0.

    Overrides are clamped to [0, 1] and a weight of 0 leaves its rows out; unknown and missing
    names weigh OTHER.
    """
    clamp = lambda w: {k: min(1.0, max(0.0, float(v))) for k, v in (w or {}).items()}
    of_section = _weight(F.col("section"), SECTION_WEIGHTS | clamp(sections), OTHER)
    of_venue = _weight(F.col("quartile"), QUARTILE_WEIGHTS | clamp(quartiles), OTHER)
    composite = F.pow(F.greatest(F.col("score"), F.lit(0.0)), F.lit(alpha)) * of_section * of_venue
    return hits.withColumn("composite", composite).where("composite > 0")


def topics(hits: DataFrame, by: list[str]) -> DataFrame:
    """For each document of the hits: mean and best composite, number of hits, mean score, and the best hit's id.

    The first of equally good hits (by rank) is the best.
    """
    return hits.groupBy(*by).agg(
        F.avg("composite").alias("avg_composite"),
        F.max("composite").alias("best_composite"),
        F.count("*").alias("hits"),
        F.avg("score").alias("avg_score"),
        F.max_by("id", F.struct("composite", -F.col("rank"))).alias("best_id"),
    )


def best_of(hits: DataFrame, key: list[str], score: str, *ties: Column) -> DataFrame:
    """The best row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), *ties)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def adjacent(chunks: DataFrame, window: int = 1) -> DataFrame:
    """(doc, idx, before, text, after): each chunk of (doc, idx, text) with the texts up to ``window`` indexes away, joined by blank lines.

    A join on document and index, so that a document with very many chunks spreads over tasks.
    Of chunks with one index the caller keeps one; missing neighbours leave gaps.
    """
    steps = F.explode(F.array(*[F.lit(s) for s in range(-window, window + 1) if s]))
    near = chunks.select("doc", "idx", "text").withColumn("step", steps)
    near = near.select("doc", (F.col("idx") + F.col("step")).alias("idx"), (-F.col("step")).alias("step"), F.col("text").alias("near_text"))
    around = near.groupBy("doc", "idx").agg(F.sort_array(F.collect_list(F.struct("step", "near_text"))).alias("near"))
    side = lambda test: F.array_join(F.transform(F.filter("near", test), lambda x: x["near_text"]), "\n\n")
    out = chunks.join(around, ["doc", "idx"], "left")
    return out.select(
        "doc", "idx", F.coalesce(side(lambda x: x["step"] < 0), F.lit("")).alias("before"), "text", F.coalesce(side(lambda x: x["step"] > 0), F.lit("")).alias("after")
    )


def merged(chunks: DataFrame, window: int = 1) -> DataFrame:
    """(doc, idx, merged): each chunk and the chunks up to ``window`` indexes away as one text, in order; empty chunks stay parts of it."""
    steps = F.explode(F.array(*[F.lit(s) for s in range(-window, window + 1)]))
    near = chunks.select("doc", "idx", "text").withColumn("step", steps)
    near = near.groupBy("doc", (F.col("idx") + F.col("step")).alias("idx")).agg(F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("step"), "text"))).alias("near"))
    out = chunks.select("doc", "idx").join(near, ["doc", "idx"])
    return out.select("doc", "idx", F.array_join(F.transform("near", lambda x: x["text"]), "\n\n").alias("merged"))
