"""Every registered graph query against its SQL on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})")
    assert mine == sorted(str(r) for r in cursor.fetchall())
