"""Tweedie models as a Spark job against the same models in memory, and against their score equations."""

import pytest
from fixtures_triangles import RAA, RAA_ULTIMATE, frame
from pyspark.sql import functions as F

from rundelta.operators import fits, glm

K = ["lob"]


@pytest.fixture(scope="module")
def cohorts(spark):
    plain = {2018: (100, 150, 172, 180), 2019: (120, 170, 200), 2020: (90, 150), 2021: (95,)}
    late = {2018: (0, 50, 72, 80), 2019: (0, 70, 90), 2020: (0, 50), 2021: (0,)}
    return frame(spark, RAA).unionByName(frame(spark, plain, "plain")).unionByName(frame(spark, late, "late")).unionByName(frame(spark, {2020: (0, 0), 2021: (0,)}, "nil"))


@pytest.mark.parametrize(
    "model",
    [fits.Tweedie(1.0, origin="none", calendar="trend"), fits.Tweedie(1.0), fits.Tweedie(1.5), fits.Tweedie(0.0, link="identity", origin="none"), fits.Tweedie(1.0, projection="increments")],
    ids=lambda m: f"{m.power}-{m.link}-{m.origin}-{m.calendar}-{m.projection}",
)
def test_models_are_those_fitted_in_memory(cohorts, model):
    got = {(r["lob"], r["origin_period"]): r for r in glm.tweedie(cohorts, K, model).collect()}
    options = {n: getattr(model, n) for n in ("link", "origin", "calendar", "projection")}
    expected = {(r["lob"], r["origin_period"]): r for r in fits.tweedie_glm(cohorts, K, model.power, **options).collect()}
    assert got.keys() == expected.keys()
    for k, e in expected.items():
        assert (got[k]["reason"] is None) == (e["error"] is None)
        if e["error"] is None:
            assert got[k]["ultimate"] == pytest.approx(e["ultimate"], rel=1e-8) and got[k]["phi"] == pytest.approx(e["phi"], rel=1e-8)
        else:
            assert got[k]["reason"] in e["error"] or got[k]["reason"] == "not_identified"


def test_poisson_is_the_chain_ladder_and_meets_its_margins(spark):
    raa = frame(spark, RAA)
    model = fits.Tweedie(1.0)
    rows, found = glm.fit_tweedie(raa, K, model)
    seen = glm.fitted_rectangle(rows, found, K, model).where("y is not null")
    for by in ("origin_period", "dev_lag"):
        for r in seen.groupBy(by).agg(F.sum("y").alias("y"), F.sum("fitted").alias("f")).collect():
            assert r["f"] == pytest.approx(r["y"], rel=1e-9)
    total = glm.tweedie(raa, K, model).agg(F.sum("ultimate")).first()[0]
    assert total == pytest.approx(RAA_ULTIMATE, rel=1e-9)


def test_what_a_power_does_not_allow_is_a_reason(spark):
    falling = frame(spark, {2018: (100, 90, 95), 2019: (100, 120), 2020: (80,)})
    assert [r["reason"] for r in glm.tweedie(falling, K, fits.Tweedie(2.0)).collect()] == ["negative_increment"]
    assert [r["reason"] for r in glm.tweedie(falling, K, fits.Tweedie(1.0, negative="refuse")).collect()] == ["negative_increment"]
    flat = frame(spark, {2018: (100, 100, 105), 2019: (100, 120), 2020: (80,)})
    assert [r["reason"] for r in glm.tweedie(flat, K, fits.Tweedie(2.0)).collect()] == ["zero_increment"]
    assert glm.tweedie(flat.limit(0), K).count() == 0
