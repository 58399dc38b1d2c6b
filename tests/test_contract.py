"""Registered queries against their SQL on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["priority_zones", "user_stats", "filter_flow", "weekly_coverage", "zone_table", "modelling_table", "nearest_distance",
        "largest_component", "moran_correlogram", "block_folds", "gap_table", "sensitivity_table"]


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in duck.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in duck.fetchall()), key=repr)
    assert sorted(names) == cols and got == want
