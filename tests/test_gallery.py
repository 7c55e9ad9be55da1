"""Every registered model fits a small book, and the registry refuses what breaks its contract."""

import pytest
from fixtures_triangles import frame
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.operators import gallery

BOOK = {2018: (100, 160, 180, 190), 2019: (110, 170, 195), 2020: (120, 200), 2021: (90,)}
OPTIONS = {"bornhuetter_ferguson": {"expected_loss_ratio": 0.6}, "odp_bootstrap": {"n_draws": 20}, "mack_simulation": {"n_draws": 20}} | {m: {"n_draws": 20, "warm": 20} for m in ("ccl", "csr", "odp", "growth")}


@pytest.fixture(scope="module")
def book(spark):
    cells = frame(spark, BOOK).drop("field")
    other = cells.withColumns({"lob": F.lit("home"), "value": F.col("value") * 1.5 + F.col("dev_lag")})
    both = cells.unionByName(other).cache()
    return both, both.select("lob", "origin_period").distinct().withColumn("premium", F.lit(300.0))


@pytest.mark.parametrize("name", sorted(gallery.entries()))
def test_entries_fit(book, name):
    entry = gallery.get(name)
    out = gallery.fit(name, *book, ["lob"], 12, **OPTIONS.get(name, {}))
    wanted = {"lob", "origin_period"} | ({"draw", "value"} if entry.kind == "draws" else {"ultimate"})
    assert wanted <= set(out.columns) and entry.card and entry.family in gallery.FAMILIES
    assert out.count() == (160 if entry.kind == "draws" else 8)


def test_the_registry_refuses():
    with pytest.raises(Refusal):
        gallery.get("nothing")
    with pytest.raises(Refusal):
        gallery.register("mack", "deterministic")(lambda *a: None)
    with pytest.raises(Refusal):
        gallery.register("new", "neural")(gallery.fit)
    assert set(gallery.entries("bayesian")) == {"ccl", "csr", "odp", "growth"}
