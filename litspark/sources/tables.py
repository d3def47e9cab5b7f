"""Tables of a directory of Parquet files, and tables written to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the folder; a file or a directory of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local session takes a temporary one and remembers it. On a
    cluster there is no folder that all executors see but the one that is named, so it must be.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("litspark.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="litspark-")
        spark.conf.set("litspark.shared.dir", folder)
    return folder.rstrip("/")


#: Bytes, as Spark estimates a table, up to which a side of a join is broadcast; files are about a quarter of what they take in memory.
SMALL = 16 << 20


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it takes at most ``limit`` bytes, else as it is.

    The size is Spark's own estimate, which is exact for a written table read whole; what is
    larger is joined by shuffle.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def written(df: DataFrame, label: str = "stage", by: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    This cuts the lineage: what follows reads files that survive a lost executor, and
    reads only the columns it needs, and with ``by`` only the parts with the values it asks for.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
