"""Queries that SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from conftest import SF001
from scripts.check_oracle import rows_of, type_mismatches
from ticketspark.llm.oracle import oracle_sql
from ticketspark.llm.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF001}/{table}.parquet')")
    df, sql = queries()[name](spark, SF001), oracle_sql()[name]
    assert type_mismatches(df, con, sql) == {}
    assert rows_of(df.toPandas()) == rows_of(con.execute(sql).df())
