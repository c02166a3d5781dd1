"""Each query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from quillgraph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark conversations".split()


def plain(rows):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert columns == sorted(want.columns)
    got = plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == plain(duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalog.ORACLES[name]}) x").fetchall())
