"""Rolling residuals and the coverage of intervals from other units."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.operators import calibration as cal

FORECASTS = "unit string, cutoff date, target date, horizon int, predicted double, size double"
ACTUALS = "unit string, eval_date date, value double"


def test_no_forecast_sees_a_later_value(spark):
    actuals = [("a", date(2000, 12, 31), 90.0), ("a", date(2001, 12, 31), 100.0), ("a", date(2002, 12, 31), 130.0), ("a", date(2009, 12, 31), 1e9), ("b", date(2000, 12, 31), 5.0), ("c", date(2002, 6, 30), float("inf"))]
    forecasts = [("a", date(2000, 12, 31), date(2001, 12, 31), 1, 80.0, 50.0), ("a", date(2000, 12, 31), date(2002, 12, 31), 2, 100.0, 50.0), ("b", date(2000, 12, 31), date(2002, 12, 31), 2, 4.0, 50.0), ("c", date(2000, 12, 31), date(2002, 12, 31), 2, 4.0, 50.0), ("d", date(2000, 12, 31), date(2002, 12, 31), 2, 4.0, 5000.0)]
    shown = spark.createDataFrame(actuals, ACTUALS)
    rows = cal.rolling_residuals(spark.createDataFrame(forecasts, FORECASTS), shown, ["unit"])
    got = {(r["unit"], r["horizon"]): (r["actual"], r["scale"], r["residual"]) for r in rows.collect()}
    assert got["a", 1] == (100.0, 80.0, 0.25) and got["a", 2] == (130.0, 100.0, 0.3)
    # Only a value from before its cutoff, one that is not finite, none at all.
    assert got["b", 2] == (None, 4.0, None) and got["c", 2][2] is None and got["d", 2] == (None, 50.0, None)
    changed = shown.withColumn("value", F.when(F.col("eval_date") > "2002-12-31", F.lit(7.0)).otherwise(F.col("value")))
    again = {(r["unit"], r["horizon"]): (r["actual"], r["scale"], r["residual"]) for r in cal.rolling_residuals(spark.createDataFrame(forecasts, FORECASTS), changed, ["unit"]).collect()}
    assert again == got


def residual_rows(n_units, seed):
    rng = random.Random(seed)
    return [(f"u{u:03d}", h, 100.0, 100.0 + round(rng.gauss(0, 10), 1 if u % 3 else 0), 1000.0 + u // 2) for u in range(n_units) for h in range(1, rng.randint(2, 4))]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "unit string, horizon int, predicted double, actual double, size double")
    scale = cal.scale_of(F.col("predicted"), F.col("size"))
    return df.withColumn("scale", scale).withColumn("residual", (F.col("actual") - F.col("predicted")) / F.col("scale"))


def test_coverage_is_that_of_pools_without_the_unit(spark):
    rows = frame(spark, residual_rows(40, 5))
    strata = cal.with_strata(rows, ["unit"], 3, least=5)
    used = strata.collect()
    expected = {}
    for level in (0.8, 0.95):
        alpha = (1 - level) / 2
        for r in used:
            pool = np.array([x["residual"] for x in used if x["stratum"] == r["stratum"] and x["unit"] != r["unit"]])
            centred = pool - np.median(pool)
            lo, hi = np.quantile(centred, [alpha, 1 - alpha], method="median_unbiased")
            expected.setdefault((r["horizon"], level), []).append(lo - 1e-12 <= r["residual"] <= hi + 1e-12)
    got = {(r["horizon"], r["nominal"]): (r["empirical"], r["n"]) for r in cal.leave_one_out_coverage(strata, ["unit"]).collect()}
    assert got.keys() == expected.keys()
    for k, held in expected.items():
        # As in the surveyed rule, the centre of the pool is taken off the bounds, not off the forecast's own error.
        assert got[k][1] == len(held) and got[k][0] == pytest.approx(np.mean(held))


def test_thin_strata_are_refused_and_pools_are_centred(spark):
    rows = frame(spark, residual_rows(12, 6))
    with pytest.raises(Refusal, match="empty_residual_pool"):
        cal.with_strata(rows, ["unit"], 4, least=40)
    pools = cal.centred_pools(cal.with_strata(rows, ["unit"], 2, least=1)).collect()
    for s in (1, 2):
        assert np.median([r["centred"] for r in pools if r["stratum"] == s]) == pytest.approx(0, abs=1e-12)
    assert len({r["stratum"] for r in pools if r["unit"] == "u003"}) == 1
