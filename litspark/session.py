"""Session builder with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold at every scale; sizes of partitions are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "litspark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; ``extra`` keys use ``_`` for ``.``.

    ``master`` is only set when given, so that spark-submit decides on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
