"""Runs over a library: what to delete, what to take first, membership of tags and collections, costs, and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delete_plan(to_index: DataFrame, changed: DataFrame, in_progress: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """(key, why): documents whose rows go before a run: changed ones, and those left in progress that have rows."""
    wanted = to_index.select(key).distinct()
    again = wanted.join(changed.select(key).distinct(), key, "left_semi").withColumn("why", F.lit("changed"))
    stale = wanted.join(in_progress.select(key).distinct(), key, "left_semi").join(indexed.select(key).distinct(), key, "left_semi")
    stale = stale.join(again.select(key), key, "left_anti").withColumn("why", F.lit("in progress"))
    return again.unionByName(stale)


def tags_set(own: Column, given: Column) -> Column:
    """The given tags in place of the own ones."""
    return given


def tags_added(own: Column, given: Column) -> Column:
    """Own and given tags, each once, in order."""
    return F.array_sort(F.array_union(F.coalesce(own, F.array().cast("array<string>")), given))


def tags_removed(own: Column, given: Column) -> Column:
    """Own tags without the given ones; order and repeats stay."""
    return F.filter(own, lambda t: ~F.array_contains(given, t))


def unknown_tags(given: Column, vocabulary: Column) -> Column:
    """Given tags that the vocabulary lacks, in order."""
    return F.array_sort(F.array_except(given, vocabulary))


def moved(members: DataFrame, target: str, arrived: DataFrame, inbox: str = "INBOX") -> DataFrame:
    """(item, collection) after items arrive in ``target``: they leave every collection that is named ``inbox``, unless it is the target."""
    new = arrived.select("item").distinct().withColumn("collection", F.lit(target))
    leaves = new.select("item", F.lit(inbox).alias("collection")).where(F.col("collection") != target)
    stay = members.select("item", "collection").distinct().join(leaves, ["item", "collection"], "left_anti")
    return stay.union(new).distinct()


def run_order(items: DataFrame, in_progress: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Items in the order of a run, those left in progress first, then by key, with ``position``; a limit comes after the order."""
    marked = items.join(in_progress.select(key).distinct().withColumn("started", F.lit(True)), key, "left").fillna(False, ["started"])
    order = [F.desc("started"), F.col(key)]
    first = marked if most is None else marked.orderBy(*order).limit(most)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def batch(items: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows and ``has_more``, from one row more than asked for."""
    w = Window.orderBy(*order)
    first = items.orderBy(*order).limit(size + 1).withColumn("n", F.row_number().over(w))
    return first.withColumn("has_more", F.max("n").over(Window.partitionBy()) > size).where(F.col("n") <= size).drop("n")


def page_ceiling(items: DataFrame, pages: Column, most: int) -> DataFrame:
    """Items with ``status``: skipped if they have over ``most`` pages; an unknown number keeps an item."""
    return items.withColumn("status", F.when(pages > most, "skipped").otherwise("kept"))


def without_attachment(items: DataFrame, attached: DataFrame, key: str) -> DataFrame:
    """(key, status, reason) of each item: skipped with a reason if it has no attachment."""
    marked = items.select(key).join(attached.select(key).distinct().withColumn("has", F.lit(True)), key, "left")
    has = F.coalesce("has", F.lit(False))
    return marked.select(key, F.when(has, "ready").otherwise("skipped").alias("status"), F.when(~has, "no attachment").alias("reason"))


def cost(usage: DataFrame, prices: DataFrame, model: str, kinds: tuple[str, ...]) -> Column:
    """Dollars of a row of ``usage`` joined to ``prices``: tokens of each kind by its price a million."""
    total = F.lit(0.0)
    for kind in kinds:
        total = total + F.coalesce(usage[kind], F.lit(0)) * F.coalesce(prices[f"{kind}_price"], F.lit(0.0))
    return total / 1e6


def cost_totals(costs: DataFrame, session: str, amount: str, when: str) -> tuple[DataFrame, DataFrame]:
    """Totals of all rows, and of each session: (rows, total, mean) and (session, rows, total, first)."""
    whole = costs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(amount), F.lit(0.0)).alias("total"), F.avg(amount).alias("mean"))
    each = costs.groupBy(session).agg(F.count("*").alias("rows"), F.sum(amount).alias("total"), F.min(when).alias("first"))
    return whole, each


def with_vectors(records: DataFrame, vectors: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """Recovered records with ``state``: ok, missing (no vector) or wrong (another dimension)."""
    joined = records.join(vectors.select(key, vector), key, "left")
    size = F.size(vector)
    return joined.withColumn("state", F.when(F.col(vector).isNull(), "missing").when(size != dimension, "wrong").otherwise("ok"))


def live_only(current: DataFrame, recovered: DataFrame, key: str) -> DataFrame:
    """Rows of both, ``origin`` recovered or live; a live row stays only if it was not recovered."""
    live = current.join(recovered.select(key), key, "left_anti").withColumn("origin", F.lit("live"))
    return recovered.withColumn("origin", F.lit("recovered")).unionByName(live)


def drift(stored: Column, settings: list[Column], flag: Column) -> Column:
    """current, flag (the stored hash is that of the settings with the flag the other way) or changed."""
    hashed = lambda f: F.substring(F.sha2(F.concat_ws(":", *settings, f.cast("string")), 256), 1, 16)
    return F.when(stored == hashed(flag), "current").when(stored == hashed(~flag), "flag").otherwise("changed")


def fallback_pages(texts: DataFrame, key: str, pages: str) -> DataFrame:
    """(key, page_num, text): a row for each text of a document's array of pages, numbered from 1; null pages are empty."""
    rows = texts.select(key, F.posexplode(pages).alias("at", "text"))
    return rows.select(key, (F.col("at") + 1).alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))
