"""Every query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from rundelta.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(frame):
    def one(v):
        if v is None or v != v:
            return None
        if hasattr(v, "year"):
            return str(v)[:10]
        if isinstance(v, (bool, str)) or str(getattr(v, "dtype", "")) == "bool":
            return str(v)
        return float(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(one(v) for v in r) for r in frame.itertuples(index=False)), key=str)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = plain(ours), plain(theirs)
    assert len(a) == len(b) and all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
