"""Registered retrieval queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from tessera.jobs import catalog_queries, index_queries, retrieval_queries

QUERIES = retrieval_queries.QUERIES | catalog_queries.QUERIES | index_queries.QUERIES
ORACLE_SQL = retrieval_queries.ORACLE_SQL | catalog_queries.ORACLE_SQL | index_queries.ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows(found):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(f"{v:.5g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in found), key=repr)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    want = sql.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(tuple(r[c] for c in names) for r in got.collect()) == rows(want.select(", ".join(f'"{c}"' for c in names)).fetchall())
