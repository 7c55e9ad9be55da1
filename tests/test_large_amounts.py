"""Queries whose amounts are as large as those of large tables."""

import shutil

import pytest
from pyspark.sql import functions as F

from rundelta.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The smallest tables with prices of 50,000 times, to totals at which a double's places are coarser than a millionth."""
    there = tmp_path_factory.mktemp("large")
    for t in ("customer", "orders"):
        shutil.copy(f"{FOLDER}/{t}.parquet", there)
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").withColumn("l_extendedprice", F.col("l_extendedprice") * 50_000).write.parquet(str(there / "lineitem.parquet"))
    return str(there)


def test_calibrated_draws_of_large_amounts_are_inside(spark, large):
    rows = catalogue.queries()["calibrated_draws"](spark, large).collect()
    assert max(r["predicted"] for r in rows) > 1e10
    assert len(rows) == 20 and all(r["n"] == 400 and r["inside"] for r in rows)
