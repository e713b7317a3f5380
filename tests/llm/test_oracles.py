"""The operators that SQL can state, against DuckDB on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from sievemill.llm import queries

SF = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(None if x is None or x != x else x for x in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(queries.ORACLES[name]).df())
