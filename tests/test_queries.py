"""Every query of the catalogue against its DuckDB equivalent, on the smallest tables."""

import duckdb
import pytest

from nearfield.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows
    if name in catalog.ORACLE_SQL:
        e = duck.sql(catalog.ORACLE_SQL[name])
        at = [e.columns.index(c) for c in sorted(e.columns)]
        assert sorted(e.columns) == columns
        assert sorted(str(tuple(r[i] for i in at)) for r in e.fetchall()) == rows
