"""Every registered query outside the training-data package against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from litspark.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return str(t.tz_convert("UTC").tz_localize(None) if t.tz else t)
    return v


def ordered(found):
    return sorted(found, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for f in Path(small).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.ORACLE:
        assert columns
        return
    wanted = duck.sql(registry.ORACLE[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert ordered(found) == ordered([tuple(plain(r[k]) for k in at) for r in wanted.fetchall()])
