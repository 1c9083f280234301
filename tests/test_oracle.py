"""Every registered capture query against its DuckDB equivalent on the smallest tables."""

import glob
import os

import duckdb
import pytest

from captureq.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cur = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = canon([tuple(r) for r in df.collect()], df.columns), canon(cur.fetchall(), names)
    assert got == want
    assert got or name in ("recorder_samples_top5",)
