"""Problem 7: duplicates hidden by formatting, counted by recursive radix partitioning and tries."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.components import components
from litspark.sources.tables import written

#: Rows that one bucket may hold, the bytes by which a bucket is split further, and those compared as one number.
CAPACITY, MORE_BYTES, PIECE = 20_000, 2, 7


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task's own rows, so that a key of a third of all rows leaves a task once a batch."""
    for b in batches:
        g = b.groupby("key", sort=False)["id"].agg(["size", "min"]).reset_index()
        yield pd.DataFrame({"key": g["key"], "copies": g["size"].astype("int64"), "first_id": g["min"].astype("int64")})


def radix_leaves(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``keys`` (key, ...) with ``leaf``, a prefix whose bucket has at most ``capacity`` rows.

    Each round splits only the oversized buckets, by the bytes that follow those that all keys of
    the bucket begin with, so that constant prefixes cost no rounds. What is left to split is
    written, so that a round reads only that. A bucket of one key can't be split and is as small
    as the tasks' own counts left it.
    """
    live = keys.withColumn("bytes", F.encode("key", "utf-8")).withColumn("leaf", F.lit("")).withColumn("width", F.lit(0))
    done = []
    while True:
        piece = F.conv(F.hex(F.expr(f"rpad(substring(bytes, width + 1, {PIECE}), {PIECE}, X'00')")), 16, 10).cast("long")
        sizes = live.groupBy("leaf", "width").agg(
            F.count("*").alias("n"), F.min(piece).alias("low"), F.max(piece).alias("high"), F.max(F.octet_length("bytes")).alias("longest")
        )
        over = sizes.where((F.col("n") > capacity) & (F.col("longest") > F.col("width")))
        # leading bytes in which the least and the greatest piece of a bucket agree
        agreed = sum((F.shiftright("low", 8 * k) == F.shiftright("high", 8 * k)).cast("int") for k in range(PIECE))
        step = F.when(agreed == PIECE, PIECE).otherwise(F.least(agreed + MORE_BYTES, F.lit(PIECE)))
        over = written(over.select("leaf", (F.col("width") + step).alias("next")), "oversized")
        if over.isEmpty():
            done.append(live)
            break
        done.append(live.join(over, "leaf", "left_anti"))
        live = live.join(over, "leaf").withColumn("leaf", F.expr("hex(substring(bytes, 1, next))"))
        live = written(live.withColumn("width", F.col("next")).drop("next"), "live")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.drop("bytes", "width")


def _add(trie: dict, word: bytes, copies: int, first: int) -> None:
    """Counts a word in a trie of edges [label, trie below, copies, first id]; an edge splits where words part."""
    while True:
        edge = trie.get(word[:1])
        if edge is None:
            trie[word[:1]] = [word, {}, copies, first]
            return
        label = edge[0]
        if word == label:
            edge[2:] = edge[2] + copies, min(edge[3], first) if edge[2] else first
            return
        if not word.startswith(label):
            label = os.path.commonprefix([word, label])
            rest = edge[0][len(label) :]
            edge = trie[word[:1]] = [label, {rest[:1]: [rest, *edge[1:]]}, 0, 0]
            continue
        trie, word = edge[1], word[len(label) :]


def _terminals(leaf: str, trie: dict) -> pd.DataFrame:
    found, stack = [], [(trie, bytes.fromhex(leaf))]
    while stack:
        node, word = stack.pop()
        for label, below, copies, first in node.values():
            if copies:
                found.append(((word + label).decode("utf-8"), copies, first))
            stack.append((below, word + label))
    return pd.DataFrame(found, columns=["key", "copies", "first_id"])


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A trie for each bucket, with a counter and the least id at the terminals; buckets come in order."""
    leaf, trie = None, {}
    for b in batches:
        for at, key, copies, first in zip(b["leaf"], b["key"], b["copies"], b["first_id"]):
            if at != leaf:
                if trie:
                    yield _terminals(leaf, trie)
                leaf, trie, skip = at, {}, len(at) // 2
            _add(trie, key.encode("utf-8")[skip:], copies, first)
    if trie:
        yield _terminals(leaf, trie)


def count_copies(df: DataFrame, id_col: str, key: Column, capacity: int = CAPACITY) -> DataFrame:
    """(key, copies, first_id): how many rows have each key, and the least id among them.

    Rows are counted in their own task first, the rest by radix buckets and tries. A null key
    names nothing and is left out; an empty string is a key. Ids must fit a long.
    """
    keyed = df.select(key.alias("key"), F.col(id_col).cast("long").alias("id")).where("key is not null and id is not null")
    partial = written(keyed.mapInPandas(_combined, "key string, copies long, first_id long"), "partial")
    leaves = radix_leaves(partial, capacity)
    # a few leaves for each task; their number is set here, as little data makes much work in a trie
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, partial.count() // (10 * capacity))
    return (
        leaves.select("leaf", "key", "copies", "first_id")
        .repartition(parts, "leaf")
        .sortWithinPartitions("leaf")
        .mapInPandas(_counted, "key string, copies long, first_id long")
    )


def copy_groups(
    df: DataFrame, id_col: str, keys: Column, scope: Column | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """(scope, rec_id, first_id, copies) of each row that names the same thing as another row of its scope.

    ``keys`` is an array of the keys a row names; rows are copies if they share a key, also by
    way of further rows. ``scope`` (default: one scope, "") parts the rows, and ids are unique
    within it. Keys are counted by ``count_copies``; rows with several keys link these, and the
    components of the links are the groups. ``first_id`` is the group's least id. Rows without a
    key or id and groups of one row are left out; repeated ids count once.
    """
    scope = F.lit("") if scope is None else F.coalesce(scope.cast("string"), F.lit(""))
    keys = F.transform(F.array_distinct(keys), lambda k: F.concat(k, F.lit("\u001f"), scope))
    rows = df.select(scope.alias("scope"), F.col(id_col).cast("long").alias("id"), keys.alias("keys"))
    rows = rows.where("size(keys) > 0 and id is not null")
    rows = written(rows.dropDuplicates(["scope", "id"]), "keyed")
    counted = written(count_copies(rows.select("id", F.explode("keys").alias("key")), "id", F.col("key"), capacity), "counted")
    several = rows.where("size(keys) > 1").select(
        F.col("keys")[0].alias("key"), F.expr("slice(keys, 2, size(keys) - 1)").alias("others")
    )
    roots = components(several.select("key", F.explode("others").alias("other")), "key", "other")
    # a row with several keys counts once in its group
    extra = several.groupBy("key").agg(F.sum(F.size("others")).alias("extra"))
    named = counted.join(roots.withColumnRenamed("node", "key"), "key", "left").join(extra, "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    groups = (
        named.groupBy("root")
        .agg((F.sum("copies") - F.sum(F.coalesce("extra", F.lit(0)))).alias("copies"), F.min("first_id").alias("first_id"))
        .where("copies > 1")
    )
    of_key = written(named.select("key", "root").join(groups, "root").select("key", "first_id", "copies"), "groups")
    return rows.select("scope", F.col("id").alias("rec_id"), F.col("keys")[0].alias("key")).join(of_key, "key").select(
        "scope", "rec_id", "first_id", "copies"
    )
