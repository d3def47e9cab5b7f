"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.sources.tables import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node sends its (larger / not larger) neighbours to the least node it sees."""
    if large:
        around = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v"), F.col("u")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    joined = around.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            least.select(F.col("u"), F.col("least").alias("v"))
        )
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the least node of each node's component, for every node with an edge.

    Null ends and loops are dropped, repeated edges count once, an empty table gives an empty
    one. No node's neighbours are gathered: a step is an aggregation and a join on the node,
    and its result is written to the shared folder. Rounds grow with the logarithm of the
    longest chain.
    """
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or now == before:
            break
        before = now
        edges = written(_stars(_stars(edges, True), False), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
