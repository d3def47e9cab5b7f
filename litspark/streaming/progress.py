"""Structured Streaming views of progress and liveness events.

Each operator is a plan on a streaming DataFrame; ``run_available`` carries one out over what is
there and returns what it has emitted. The same plans run continuously with another trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from litspark.sources.tables import shared_folder

#: How late an event may come.
LATE = "1 hour"


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The event table as a file stream, its times as timestamps, with a watermark."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def run_available(stream: DataFrame, keyed: str | None = None) -> DataFrame:
    """Runs a streaming plan over what is available and returns the emitted rows.

    Rows go to files in append mode. ``keyed`` names the key of a plan whose rows change: a batch
    writes only the keys it changed, into a folder of its own, and the last row of each key counts.
    State and output lie in the shared folder, so that a lost executor repeats a batch.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if keyed:
        writer = writer.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    else:
        writer = writer.outputMode("append").format("parquet").option("path", f"{base}/out")
    writer.start().awaitTermination()
    if not keyed:
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{base}/out")
    last = rows.groupBy(keyed).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return last.select("r.*")


def windowed(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of closed windows."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, last, n) of closed sessions: events of a user no further apart than ``gap``."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return out.select("user_id", F.col("w.start").alias("start"), "last", "n")


def unique(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key; a key is forgotten after the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def first_of_period(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, event_id, ts): events of a key that come ``seconds`` or more after the last one taken.

    The time of the last event taken is the state of a key, which is forgotten when the watermark
    has passed it by the period; a batch's events are taken in order of time.
    """
    period = pd.Timedelta(seconds=seconds)

    def taken(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last, out = pd.Timestamp(state.get[0], unit="us") if state.exists else None, []
        for event, ts in zip(rows["event_id"], rows["ts"]):
            if last is None or ts - last >= period:
                last = ts
                out.append((name[0], event, ts))
        state.update((last.value // 1000,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last.value // 1_000_000 + seconds * 1000))
        if out:
            yield pd.DataFrame(out, columns=[key, "event_id", "ts"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(
        taken, f"{key} {kind}, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest(events: DataFrame, key: str) -> DataFrame:
    """(key, ts, event_type, n): the last event of each key so far."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("e")
    return events.groupBy(key).agg(last, F.count("*").alias("n")).select(key, F.col("e.ts").alias("ts"), F.col("e.event_type").alias("event_type"), "n")


def answered(events: DataFrame, ask: str, answer: str, within: str, unconfirmed: bool = False) -> DataFrame:
    """(user_id, asked, answered): pairs of a command and a result of a user, the result at most ``within`` later.

    With ``unconfirmed`` commands without a result come too, with a null, once the watermark has
    passed the time in which one could still come.
    """
    a = events.where(F.col("event_type") == ask).select("user_id", F.col("event_id").alias("asked"), F.col("ts").alias("asked_ts"))
    b = events.where(F.col("event_type") == answer).select(F.col("user_id").alias("who"), F.col("event_id").alias("answered"), F.col("ts").alias("answered_ts"))
    near = F.expr(f"who = user_id and answered_ts >= asked_ts and answered_ts <= asked_ts + interval {within}")
    return a.join(b, near, "left_outer" if unconfirmed else "inner").select("user_id", "asked", "answered")


def run_events(events: DataFrame, run: str) -> DataFrame:
    """(run, position, event_type, ts): the events of each run in order of time, numbered from 1; the batch view of an append-only log."""
    w = Window.partitionBy(run).orderBy("ts", "event_id")
    return events.select(run, "event_type", "ts", F.row_number().over(w).alias("position"))
