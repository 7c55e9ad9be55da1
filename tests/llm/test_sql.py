"""The operators that SQL can state, against DuckDB over the smallest folder."""

import duckdb
import pandas as pd
import pytest

from rundelta.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(frame):
    """Rows in one order, numbers that pandas widened for the sake of nulls as they were."""

    def one(v):
        if pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(one, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ours = queries.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) > 0
    assert plain(ours) == plain(theirs)
