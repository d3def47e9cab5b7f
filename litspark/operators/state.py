"""State of an index: what is indexed, orphaned, changed; runs and their failures; recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def authoritative(current: DataFrame, stored: DataFrame, journal: DataFrame) -> DataFrame:
    """(doc): current and stored documents that the journal (doc, state) has committed or never touched."""
    both = current.select("doc").distinct().join(stored.select("doc").distinct(), "doc", "left_semi")
    open_ = journal.groupBy("doc").agg(F.max((F.col("state") == "committed").cast("int")).alias("done")).where("done = 0")
    return both.join(open_, "doc", "left_anti")


def orphans(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc): stored documents that are no longer current."""
    return stored.select("doc").distinct().join(current, "doc", "left_anti")


def deletion(current: DataFrame, stored: DataFrame, floor: float = 0.25, allow: bool = False) -> DataFrame:
    """One row (stored, orphans, share, decision): delete, refuse, or nothing; over ``floor`` it takes ``allow``, and an empty library refuses."""
    lost = orphans(current, stored).agg(F.count("*").alias("orphans"))
    have = stored.agg(F.count_distinct("doc").alias("stored"))
    live = current.limit(1).agg(F.count("*").alias("live"))
    row = have.crossJoin(lost).crossJoin(live).withColumn("share", F.col("orphans") / F.greatest("stored", F.lit(1)))
    decision = F.when(F.col("orphans") == 0, "nothing").when(F.col("live") == 0, "refuse").when((F.col("share") > floor) & ~F.lit(allow), "refuse").otherwise("delete")
    return row.select("stored", "orphans", "share", decision.alias("decision"))


def reindex_reason(items: DataFrame, state: DataFrame) -> DataFrame:
    """(doc, reason) of items (doc, hash) against the index state (doc, hash, stage): new, no_hash, changed, stale_in_progress, current."""
    old = state.select("doc", F.col("hash").alias("old"), "stage", F.lit(True).alias("known"))
    reason = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("stage") == "in_progress", "stale_in_progress")
        .when(F.col("old").isNull() | (F.col("old") == ""), "no_hash")
        .when(F.col("old") != F.col("hash"), "changed")
        .otherwise("current")
    )
    return items.join(old, "doc", "left").select("doc", reason.alias("reason"))


def failure_islands(runs: DataFrame, run: str, order: list[Column], failed: Column, signature: Column, least: int = 3) -> DataFrame:
    """(run, island, length, signature): runs of at least ``least`` failures in a row with one signature.

    A success or another signature ends an island.
    """
    w = Window.partitionBy(run).orderBy(*order)
    marked = runs.withColumn("_failed", failed).withColumn("_sig", F.when(failed, signature))
    new = F.when(F.col("_failed") & F.col("_sig").eqNullSafe(F.lag("_sig").over(w)) & F.coalesce(F.lag("_failed").over(w), F.lit(False)), 0).otherwise(1)
    marked = marked.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    out = marked.where("_failed").groupBy(run, "island").agg(F.count("*").alias("length"), F.first("_sig").alias("signature"))
    return out.where(F.col("length") >= least)


def after_abort(runs: DataFrame, run: str, order: list[Column], failed: Column, limit: int = 3) -> DataFrame:
    """Rows with ``status``: failed, done, or "not attempted" after the run's ``limit``-th failure in a row."""
    w = Window.partitionBy(run).orderBy(*order)
    marked = runs.withColumn("_failed", failed.cast("int"))
    recent = F.sum("_failed").over(w.rowsBetween(-(limit - 1), 0))
    marked = marked.withColumn("_abort", F.max((recent == limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    status = F.when(F.coalesce("_abort", F.lit(0)) == 1, "not attempted").when(F.col("_failed") == 1, "failed").otherwise("done")
    return marked.withColumn("status", status).drop("_failed", "_abort")


def first_outcome_gate(runs: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """Rows with ``gate``: the first of each key is a trial; the rest pass if it went well, and are skipped if not.

    The first row of a key is an aggregate, combined before the shuffle, so that a key of very many
    rows is never sorted in one task. ``order`` is unique within a key; null keys are one key.
    """
    firsts = runs.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order, ok.alias("_ok"))).alias("_first"))
    same = F.struct(*[F.col(c) for c in order]).eqNullSafe(F.struct(*[F.col(f"_first.{c}") for c in order]))
    gate = F.when(same, "trial").when(F.coalesce("_first._ok", F.lit(False)), "pass").otherwise("skip")
    return runs.join(firsts, F.col(key).eqNullSafe(F.col("_key"))).withColumn("gate", gate).drop("_key", "_first")


def reassembled(fields: DataFrame, names: list[str]) -> DataFrame:
    """(id, text): metadata rows (id, key, string_value, int_value, float_value, bool_value) as one JSON object for each id, keys in order.

    Of the typed values the first that is not null counts; a repeated key keeps its greatest value.
    """
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    out = fields.groupBy("id").agg(*[F.max(F.when(F.col("key") == n, value)).alias(n) for n in names])
    return out.select("id", F.to_json(F.struct(*names)).alias("text"))
