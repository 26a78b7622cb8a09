"""Queries against their SQL in DuckDB."""

import duckdb
import pytest

from tessella.llm import queries


@pytest.mark.parametrize("name", ["op12_reduced_alphabet", "op13_coordinate_join"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want, found = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple((v is not None, v) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    assert got == sorted((tuple(map(dict(zip(want.columns, r, strict=True)).get, columns)) for r in want.fetchall()), key=key) and got
