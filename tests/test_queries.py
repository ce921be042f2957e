"""Every registered query of the library against its SQL."""

import duckdb
import pytest

from larkspur import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, sf, db, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert got
        return
    rel = db.sql(plans.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
