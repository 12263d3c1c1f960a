"""The queries of this subpackage that have SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.llm import registry

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    order = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert order(df.select(*[f"`{c}`" for c in names]).collect()) == order(got.fetchall())
