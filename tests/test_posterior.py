"""Posterior samplers and stacking, against closed forms and known truth."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rundelta.functions.ranks import medians, ranked, with_ntile
from rundelta.operators import fits, posterior, predictive

K = ["lob"]


def simulated(n=9, noise=0.01, seed=1):
    """Origins of nearly one loss ratio, and what they come to."""
    rng = np.random.default_rng(seed)
    premium = 1000.0 * (1 + 0.03 * np.arange(n))
    share = 1 - np.exp(-0.4 * (np.arange(n) + 1))
    full = premium[:, None] * 0.65 * np.exp(0.05 * rng.normal(size=n))[:, None] * share / share[-1] * np.exp(noise * rng.normal(size=(n, n)))
    full = np.maximum.accumulate(full, axis=1)
    rows = [("auto", pd.Timestamp(2010 + w, 1, 1).date(), 12 * (d + 1), pd.Timestamp(2010 + w + d, 12, 31).date(), float(full[w, d])) for w in range(n) for d in range(n - w)]
    return rows, [("auto", pd.Timestamp(2010 + w, 1, 1).date(), float(premium[w])) for w in range(n)], full[:, -1].sum()


@pytest.fixture(scope="module")
def tables(spark):
    cells, premium, truth = simulated()
    return spark.createDataFrame(cells, "lob string, origin_period date, dev_lag bigint, eval_date date, value double"), spark.createDataFrame(premium, "lob string, origin_period date, premium double"), truth


@pytest.mark.parametrize("model", posterior.MODELS)
def test_posteriors_cover_the_truth(tables, model):
    cells, premium, truth = tables
    draws = posterior.posterior(cells, premium, K, model, curve="weibull", n_draws=400, warm=400, seed=4).cache()
    assert draws.where("error is not null").count() == 0
    total = draws.groupBy("lob", "draw").agg(F.sum("value").alias("value")).cache()
    # Log models have heavy tails in a triangle of this size, so their middle is what is looked at.
    low, middle, high = total.agg(F.percentile("value", [0.1, 0.5, 0.9])).first()[0]
    assert middle == pytest.approx(truth, rel=0.08) and 0.97 * low < truth < 1.03 * high and high - low < 0.5 * truth
    logs = total.withColumn("value", F.ln("value"))
    assert fits.convergence(logs, K).first()["r_hat"] < 1.2
    again = posterior.posterior(cells.repartition(3), premium, K, model, curve="weibull", n_draws=400, warm=400, seed=4).cache()
    assert again.groupBy("draw").agg(F.sum("value").alias("v")).agg(F.percentile("v", 0.5)).first()[0] == pytest.approx(middle)
    other = posterior.posterior(cells, premium, K, model, curve="weibull", n_draws=400, warm=400, seed=5).groupBy("lob", "draw").agg(F.ln(F.sum("value")).alias("value"))
    same = posterior.compare_posteriors(logs, other, K).first()
    assert same["agree"], same
    assert not posterior.compare_posteriors(logs, other.withColumn("value", F.col("value") + 0.5), K).first()["agree"]


def test_refused_cohorts_are_rows(spark, tables):
    cells, premium, _ = tables
    zero = cells.withColumn("value", F.when(F.col("dev_lag") == 12, 0.0).otherwise(F.col("value")))
    assert "not_supported" in posterior.posterior(zero, premium, K, "ccl", n_draws=5, warm=5).first()["error"]
    falls = cells.withColumn("value", F.when(F.col("dev_lag") == 24, 1.0).otherwise(F.col("value")))
    assert "negative_increment" in posterior.posterior(falls, premium, K, "odp", n_draws=5, warm=5).first()["error"]


def test_slices_follow_their_density():
    rng, x, out = np.random.default_rng(3), 0.5, []
    for _ in range(6000):
        x = posterior.slice_step(rng, lambda v: np.log(v) + 2 * np.log1p(-v), x, 1e-12, 1 - 1e-12)
        out.append(x)
    assert np.mean(out) == pytest.approx(0.4, abs=0.02) and np.var(out) == pytest.approx(0.04, abs=0.005)


def test_stacking_is_the_best_mixture(spark):
    rng = np.random.default_rng(6)
    p = rng.gamma(1.0, 1.0, (400, 4)) + 1e-3
    p[:, 3] *= 0.2
    rows = [(i, m, float(np.log(p[i, k]))) for i in range(400) for k, m in enumerate("abcd")]
    got = predictive.stacking_weights(spark.createDataFrame(rows, "cell int, model string, elpd double"), ["cell"])
    w = np.full(4, 0.25)
    for _ in range(20_000):
        share = p * w
        w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
    assert [got[m] for m in "abcd"] == pytest.approx(w.tolist(), abs=1e-6)
    assert got["d"] == 0.0 and sum(got.values()) == pytest.approx(1.0)
    one = spark.createDataFrame([(1, "a", -1.0)], "cell int, model string, elpd double")
    assert predictive.stacking_weights(one, ["cell"]) == {"a": 1.0}


def test_ranks_strata_and_medians(spark):
    rng = np.random.default_rng(9)
    values = rng.integers(0, 40, 1001).tolist()
    df = spark.createDataFrame([(i, "ab"[i % 2], float(v)) for i, v in enumerate(values)], "i int, g string, v double").repartition(5)
    got = sorted((r["rank"], r["v"]) for r in ranked(df, ["v"]).collect())
    assert [r for r, _ in got] == list(range(1, 1002)) and [v for _, v in got] == sorted(map(float, values))
    bins = [r["count"] for r in with_ntile(df, ["v"], 4, "b").groupBy("b").count().orderBy("b").collect()]
    assert bins == [251, 250, 250, 250]
    few = [r["count"] for r in with_ntile(df.where("i < 3"), ["v"], 4, "b").groupBy("b").count().orderBy("b").collect()]
    assert few == [1, 1, 1]
    by = {r["g"]: r["m"] for r in medians(df, ["g"], "v", "m").collect()}
    assert by == {g: float(np.median([v for i, v in enumerate(values) if "ab"[i % 2] == g])) for g in "ab"}
    assert medians(df, [], "v", "m").first()["m"] == float(np.median(values))
    q = predictive.quantile_type8(df, ["g"], "v", 0.9).collect()
    for r in q:
        assert r["quantile"] == pytest.approx(float(np.quantile([v for i, v in enumerate(values) if "ab"[i % 2] == r["g"]], 0.9, method="median_unbiased")))
