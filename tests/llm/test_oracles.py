"""The training-data queries with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SMALL
from tests.test_oracles import TABLES, _rows
from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(name, spark):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    r = c.sql(registry.oracle_sql()[name])
    assert _rows(df.columns, [tuple(x) for x in df.collect()]) == _rows(r.columns, r.fetchall())
