"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from kinelake.plans import model_queries, queries, source_queries, track_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool | str):
        return v
    return round(float(v), 3)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(norm(v) if not isinstance(v, list) else str(v) for v in r) for r in df.collect()]
    if name not in queries.SQL:
        assert rows
        return
    got = duck.execute(queries.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = [tuple(norm(r[i]) for i in order) for r in got.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)
