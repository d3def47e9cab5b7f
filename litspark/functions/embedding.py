"""Embeddings without a network: words hashed to signed dimensions, and vectors looked up by key."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed(texts: pd.Series) -> pd.Series:
    """A unit vector of DIMENSIONS numbers for each text: the sum of its words' signed dimensions; null and empty texts give zeros."""
    known: dict[str, tuple[int, float]] = {}
    out = []
    for text in texts:
        v = np.zeros(DIMENSIONS, dtype=np.float32)
        for word in (text or "").lower().split():
            if word not in known:
                h = zlib.crc32(word.encode("utf-8"))
                known[word] = h % DIMENSIONS, 1.0 if h & 0x80000000 else -1.0
            at, sign = known[word]
            v[at] += sign
        norm = float(np.linalg.norm(v))
        out.append(v / norm if norm else v)
    return pd.Series(out)


def embedded(df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
    """``df`` with the hashed embedding of a text column."""
    return df.withColumn(out, hashed(F.col(text_col)))


def checked(vector: Column, dimensions: int) -> Column:
    """The vector, or an error if it has another number of dimensions; null stays null."""
    wrong = vector.isNotNull() & (F.size(vector) != dimensions)
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, got "), F.size(vector).cast("string")))).otherwise(vector)
