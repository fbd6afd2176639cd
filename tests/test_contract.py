"""Every query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tessera import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or str(v) in ("nan", "<NA>", "None"):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def same(spark, name, sql, f):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a, b = f(spark, SF).toPandas(), con.sql(sql).df()
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    rows = lambda x: sorted(str([plain(v) for v in r]) for r in x[names].astype(object).itertuples(index=False, name=None))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    same(spark, name, queries.ORACLE[name], queries.QUERIES[name])


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
