"""Queries that have SQL, against DuckDB on the supplied tables."""

import duckdb
import pytest

from loanwatch.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want) and want
