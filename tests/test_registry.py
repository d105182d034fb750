"""Queries against their SQL at the smallest scale. SIGHTLINE_ALL=1 runs every query."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import rows_of
from sightline.sources.tables import TABLES

QUICK = [
    "rq1_rates_fisher", "rq1_odds", "rq2_tier_summary", "rq3_geo", "rq3_underscreened", "rq4_top_domain",
    "rq5_yoy", "profile_missing", "describe_numeric", "column_roles_planted", "rel_num_num", "rel_cat_num_groups",
    "rel_cat_bin_groups", "rel_bin_num", "feat_score", "rate_gap", "impute", "merge_inner", "hist_20",
    "join_candidates", "csv_roundtrip", "csv_malformed",
]
CHOSEN = sorted(oracle_sql()) if os.environ.get("SIGHTLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, tiny, duck, name):
    df = queries()[name](spark, tiny)
    cur = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_entry_has_six_domains(spark):
    assert entry(spark).count() == 6


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
