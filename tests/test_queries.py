"""Every slide query against its DuckDB equivalent on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tessera.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.9g}" if isinstance(x, (int, float)) else str(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_oracle(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(map(value, r)) for r in found.fetchall())
    assert sorted(tuple(value(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_oracle_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert contract.entry(spark).columns == ["slide_id", "patch_idx", "passport"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
    corpus = os.path.isdir(os.path.join(contract.ROOT, "tessera", "llm"))
    assert corpus == any(n.startswith("op1_") for n in contract.queries())
