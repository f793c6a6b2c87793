"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tests.conftest import SMALL
from tidemark.plans import audits, extras, kept, reports, rounds, series

ALL = series.QUERIES | reports.QUERIES | audits.QUERIES | extras.QUERIES | rounds.QUERIES | kept.QUERIES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(columns), sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(name, spark, duck):
    run, sql = ALL[name]
    df = run(spark, SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        assert got[1]
        return
    r = duck.sql(sql)
    assert got == _rows(r.columns, r.fetchall())
