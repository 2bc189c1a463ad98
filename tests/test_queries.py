"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from glyphmill.plans.oracles import oracles
from glyphmill.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def rows(found):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in oracles()])
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracles()[name]})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(oracles()) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
