"""Each query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tessella.jobs import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    rows, want = found.toPandas(), duck.sql(catalog.ORACLE_SQL[name])
    kinds, want_frame = dict(zip(want.columns, map(str, want.types), strict=True)), want.df()
    columns = sorted(want_frame.columns)
    assert columns == sorted(rows.columns)
    assert {c: KINDS[kinds[c]] for c in columns} == dict(found.dtypes)
    a = want_frame[columns].sort_values(columns).reset_index(drop=True)
    b = rows[columns].sort_values(columns).reset_index(drop=True)
    assert len(a) == len(b) > 0
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
