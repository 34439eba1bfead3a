"""Every query against its SQL, compared as the sorted rows of both."""

import math

import duckdb
import pytest

from fareindex import queries as q

TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, round(v, 3) if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    run, text = q.QUERIES[name]
    df = run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if not text:
        assert got
        return
    rel = duck.sql(text)
    assert sorted(rel.columns) == sorted(df.columns)
    want = rel.select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, (float, int)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-4), (a, b)
