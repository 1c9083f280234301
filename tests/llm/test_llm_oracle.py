"""The training-text queries that have SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from captureq.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    cur = duck.execute(queries.ORACLES[name])
    names = sorted(x[0] for x in cur.description)
    assert names == sorted(df.columns)
    want = cur.df()[names].astype(object).where(lambda x: x.notna(), None).map(lambda x: x if x is None or isinstance(x, (str, bool)) else int(x))
    got = df.select(*names).toPandas().astype(object).where(lambda x: x.notna(), None).map(lambda x: x if x is None or isinstance(x, (str, bool)) else int(x))
    assert sorted(map(repr, want.itertuples(index=False, name=None))) == sorted(map(repr, got.itertuples(index=False, name=None)))
