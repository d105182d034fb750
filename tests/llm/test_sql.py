"""Queries of the training-data operators against their SQL at the smallest scale."""

import duckdb
import pytest

from check_oracles import rows_of
from sightline.llm.queries import ORACLES, QUERIES
from sightline.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op6_warc"])
def test_matches_sql(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())
