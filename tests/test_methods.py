import math

import numpy as np

import pytest
from fixtures_triangles import RAA, RAA_SE, RAA_ULTIMATE, SMALL, frame
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.operators import fits, methods, simulate
from rundelta.operators import mack as mk
from rundelta.operators.links import LinkRules, exhausted, link_factors, select_links

K = ["lob"]


def ultimates(df):
    return [r["ultimate"] for r in df.orderBy("origin_period").collect()]


@pytest.fixture(scope="module")
def raa(spark):
    return frame(spark, RAA).drop("field").cache()


@pytest.fixture(scope="module")
def premium(spark, raa):
    return raa.select("lob", "origin_period").distinct().withColumn("premium", 20000.0 + 20000.0 / 9 * (F.year("origin_period") - 1981))


def test_small_chain_ladder(spark):
    assert ultimates(methods.chain_ladder(frame(spark, SMALL), K, 12)) == pytest.approx([175, 192.5, 210])


def test_raa_totals(raa):
    total = mk.mack_totals(raa, K, 12).first()
    assert total["ultimate"] == pytest.approx(RAA_ULTIMATE, rel=1e-12)
    assert total["mack_se"] == pytest.approx(RAA_SE, rel=1e-9)


def test_many_cohorts_are_one_plan(spark, raa):
    both = raa.unionByName(raa.withColumns({"lob": F.lit("twice"), "value": F.col("value") * 2}))
    found = {r["lob"]: r["ultimate"] for r in methods.totals(methods.chain_ladder(both, K, 12), K).collect()}
    assert found["auto"] == pytest.approx(RAA_ULTIMATE) and found["twice"] == pytest.approx(2 * RAA_ULTIMATE) and found[None] == pytest.approx(3 * RAA_ULTIMATE)


def test_premium_methods_agree_at_their_limits(raa, premium):
    cl = ultimates(methods.chain_ladder(raa, K, 12))
    assert ultimates(methods.benktander(raa, premium, K, 12, 0.6, n_iters=2000)) == pytest.approx(cl, rel=1e-4)
    assert ultimates(methods.benktander(raa, premium, K, 12, 0.6, n_iters=1)) == pytest.approx(ultimates(methods.bornhuetter_ferguson(raa, premium, K, 12, 0.6)))
    assert ultimates(methods.cape_cod(raa, premium, K, 12, decay=0.0)) == pytest.approx(cl)


def test_rules_give_reasons(raa):
    links = select_links(raa, K, 12, LinkRules(history_periods=5, exclude=(("1986-01-01", 12),), drop_high=1))
    reasons = {r["reason"]: r["n"] for r in links.where("dev_lag = 12").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert reasons == {None: 3, "history_window": 4, "explicit_exclusion": 1, "drop_high": 1}
    emptied = LinkRules(exclude=(("1981-01-01", 108),), drop_high=1)
    spent = select_links(raa, K, 12, emptied).where("dev_lag = 108")
    assert [(r["included"], r["reason"], r["trimming_skipped"]) for r in spent.collect()] == [(False, "explicit_exclusion", False)]
    assert exhausted(spent, K).count() == 0
    factor = link_factors(select_links(raa, K, 12, emptied), K).where("dev_lag = 108").first()
    assert factor["unity_fallback"] and factor["factor"] == 1.0 and factor["n_selected"] == 0
    by_date = select_links(raa, K, 12, LinkRules(exclude_valuations=("1990-12-31",))).where("dev_lag = 108").first()
    assert by_date["reason"] == "valuation_exclusion"
    kept = select_links(raa, K, 12, LinkRules(drop_high=1, drop_low=1, preserve=1)).where("dev_lag = 96").collect()
    assert all(r["trimming_skipped"] and r["included"] for r in kept)


def test_an_emptied_age_is_reported_and_spreads_no_error(raa):
    rules = LinkRules(exclude=(("1981-01-01", 108),))
    rows = {r["dev_lag"]: r for r in mk.mack_factors(raa, K, 12, rules=rules).collect()}
    assert rows[108]["reason"] == "no_link_ratio" and rows[108]["sigma2"] is None and rows[108]["factor"] == 1.0 and rows[108]["n"] == 0
    assert rows[12]["reason"] is None
    origins = {r["latest_dev"]: r for r in mk.mack(raa, K, 12, rules=rules).collect()}
    assert origins[120]["mack_se"] == 0.0 and origins[108]["mack_se"] is None and origins[12]["mack_se"] is None


def test_zero_cells_and_fallback(spark):
    df = frame(spark, {2020: (0, 10, 20), 2021: (0, 12), 2022: (5,)})
    links = select_links(df, K, 12)
    assert {r["reason"] for r in links.where("dev_lag = 12").collect()} == {"zero_cell"}
    factor = link_factors(links, K).where("dev_lag = 12").first()
    assert factor["unity_fallback"] and factor["factor"] == 1.0
    assert {r["reason"] for r in select_links(df, K, 12, LinkRules(zero_cells="observed")).where("dev_lag = 12").collect()} == {"undefined_ratio"}


def test_constant_tail_steps():
    steps = methods.constant_tail_steps(1.08, 12)
    assert math.prod(steps) == pytest.approx(1.08) and steps[0] > steps[1] > 1


def test_curves(spark, raa):
    f = link_factors(select_links(raa, K, 12), K)
    out = methods.curve_tail(f, K, 12, "exponential").first()
    assert out["tail_factor"] > 1 and out["reason"] is None
    product = 1.0
    for t in range(10, 110):
        product *= 1 + math.exp(out["intercept"] + out["slope"] * t)
    assert out["tail_factor"] == pytest.approx(product)
    assert methods.curve_tail(f.where("dev_lag = 12"), K, 12, "weibull").first()["reason"] == "not_identified"


def test_simulation_agrees_with_the_formula(raa):
    draws = simulate.mack_simulate(raa, K, 12, n_draws=4000, seed=7, process="normal")
    total = draws.groupBy("draw").agg(F.sum("value").alias("v")).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    expected = mk.mack_totals(raa, K, 12, sigma_rule="mack").first()
    assert total["m"] == pytest.approx(expected["ultimate"], rel=0.03)
    assert total["s"] == pytest.approx(expected["mack_se"], rel=0.12)
    again = simulate.mack_simulate(raa.repartition(3), K, 12, n_draws=4000, seed=7, process="normal")
    # Another partitioning adds the same numbers in another order, so factors may differ in their last bits.
    both = draws.join(again.withColumnRenamed("value", "other"), ["lob", "origin_period", "draw"])
    assert both.where("abs(value - other) <= 1e-6 * abs(value)").count() == draws.count()


def test_one_year_simulation_agrees_with_the_formula(raa):
    _, total = mk.one_year_cdr(raa, K, 12)
    draws = simulate.mack_simulate(raa, K, 12, n_draws=4000, seed=3, process="normal", one_year=True)
    assert simulate.simulated_msep(draws, K).first()["cdr_se"] == pytest.approx(total.first()["cdr_se"], rel=0.12)


def test_bootstrap_centres_on_the_chain_ladder(raa):
    draws = simulate.odp_bootstrap(raa, K, n_draws=3000, seed=5)
    mean = draws.groupBy("draw").agg(F.sum("value").alias("v")).agg(F.avg("v")).first()[0]
    ibnr = methods.totals(methods.chain_ladder(raa, K, 12), K).where("lob is not null").first()["ibnr"]
    assert mean == pytest.approx(ibnr, rel=0.08)


def test_poisson_glm_is_the_chain_ladder(raa):
    assert ultimates(fits.tweedie_glm(raa, K, 1.0)) == pytest.approx(ultimates(methods.chain_ladder(raa, K, 12)), rel=1e-6)


def test_failed_fit_is_a_row(spark):
    bad = frame(spark, {2020: (-5, -5)})
    assert fits.tweedie_glm(bad, K, 2.0).first()["error"] is not None


def test_systems_of_one_line_are_volume_factors(raa):
    one = raa.withColumn("company", F.lit("x"))
    assert ultimates(fits.multivariate_chain_ladder(one, ["company"], "lob", full=False)) == pytest.approx(ultimates(methods.chain_ladder(raa, K, 12)), rel=1e-6)


def test_clark(raa, premium):
    out = fits.clark(raa, premium, K, method="ldf").orderBy("origin_period").collect()
    assert all(r["error"] is None and r["ultimate"] >= r["latest"] for r in out)


MW2014 = (
    "13109 20355 21337 22043 22401 22658 22997 23158 23492 23664 23699 23904 23960 23992 23994 24001 24002",
    "14457 22038 22627 23114 23238 23312 23440 23490 23964 23976 24048 24111 24252 24538 24540 24550",
    "16075 22672 23753 24052 24206 24757 24786 24807 24823 24888 24986 25401 25681 25705 25732",
    "15682 23464 24465 25052 25529 25708 25752 25770 25835 26075 26082 26146 26150 26167",
    "16551 23706 24627 25573 26046 26115 26283 26481 26701 26718 26724 26728 26735",
    "15439 23796 24866 25317 26139 26154 26175 26205 26764 26818 26836 26959",
    "14629 21645 22826 23599 24992 25434 25476 25549 25604 25709 25723",
    "17585 26288 27623 27939 28335 28638 28715 28759 29525 30302",
    "17419 25941 27066 27761 28043 28477 28721 28878 28948",
    "16665 25370 26909 27611 27729 27861 29830 29844",
    "15471 23745 25117 26378 26971 27396 27480",
    "15103 23393 26809 27691 28061 29183",
    "14540 22642 23571 24127 24210",
    "14590 22336 23440 24029",
    "13967 21515 22603",
    "12930 20111",
    "12539",
)


def test_published_one_year_results(spark):
    """Merz and Wuethrich (2014): published total and the second origin, whose one year is its whole run-off."""
    cells = frame(spark, {1990 + n: tuple(map(int, r.split())) for n, r in enumerate(MW2014)})
    per_origin, total = mk.one_year_cdr(cells, K, 12)
    t, run_off = total.first(), mk.mack_totals(cells, K, 12, sigma_rule="mack").first()
    assert t["ibnr"] == pytest.approx(24134.870088, abs=1e-5)
    assert t["cdr_se"] == pytest.approx(1842.8507073, abs=1e-5)
    assert run_off["mack_se"] == pytest.approx(3233.6807352, abs=1e-5)
    rows = per_origin.orderBy("origin_period").collect()
    assert rows[1]["cdr_se"] == pytest.approx(0.4083149, abs=1e-6) and rows[0]["cdr_se"] == 0
    assert rows[4]["cdr_se"] == pytest.approx(156.4022713, abs=1e-6) and rows[16]["cdr_se"] == pytest.approx(733.2222786, abs=1e-6)


def test_sigma_rules_at_the_ends_and_in_gaps(spark):
    two = frame(spark, {2020: (100, 150), 2021: (110,)})
    assert mk.mack_factors(two, K, 12, sigma_rule="mack").first()["sigma2"] == 0.0
    three = frame(spark, {2019: (90, 130, 140), 2020: (100, 150), 2021: (110,)})
    first, last = mk.mack_factors(three, K, 12, sigma_rule="mack").orderBy("dev_lag").collect()
    assert last["sigma2"] == first["sigma2"] > 0 and last["sigma_extrapolated"]
    gap = frame(spark, {2017: (0, 80, 90, 95, 97), 2018: (0, 85, 93, 99), 2019: (0, 130, 140), 2020: (100, 150), 2021: (110,)})
    rows = {r["dev_lag"]: r for r in mk.mack_factors(gap, K, 12, sigma_rule="mack").collect()}
    assert rows[12]["reason"] == "variance_not_estimable" and rows[12]["sigma2"] is None and rows[24]["reason"] is None
    filled = {r["dev_lag"]: r for r in mk.mack_factors(gap, K, 12).collect()}
    assert filled[12]["sigma2"] > 0 and filled[12]["reason"] is None


def test_tail_variance(spark, raa):
    f = mk.mack_factors(raa, K, 12, sigma_rule="mack")
    tail = lambda **c: methods.constant_tail(raa, K, c.pop("f")).withColumns({k: F.lit(v) for k, v in c.items()})
    r = mk.tail_variance(f, K, 12, tail(f=1.05)).first()
    assert r["position"] > 1 and r["tail_sigma2"] > 0 and r["tail_se2"] > 0 and r["reason"] is None
    one = mk.tail_variance(f, K, 12, tail(f=1.0)).first()
    assert (one["tail_sigma2"], one["tail_se2"], one["reason"]) == (0.0, 0.0, None)
    assert mk.tail_variance(f, K, 12, tail(f=0.9)).first()["reason"] == "variance_not_estimable"
    assert mk.tail_variance(f, K, 12, tail(f=1e9)).first()["reason"] == "variance_not_estimable"
    given = mk.tail_variance(f, K, 12, tail(f=0.9, tail_sigma=3.0, tail_std_err=0.1)).first()
    assert given["tail_sigma2"] == pytest.approx(9.0) and given["reason"] is None
    plain, tailed = mk.mack_totals(raa, K, 12).first(), mk.mack_totals(raa, K, 12, tail=tail(f=1.0)).first()
    assert tailed["mack_se"] == pytest.approx(plain["mack_se"], rel=1e-12)


def test_exhausted_rules_raise(raa):
    with pytest.raises(Refusal) as e:
        select_links(raa, K, 12, LinkRules(drop_high=2, drop_low=1, exhausted_exclusions="raise"))
    assert e.value.reason == "exclusions_exhausted"
    assert select_links(raa, K, 12, LinkRules(drop_above=100.0, exhausted_exclusions="raise")).count() == 45


def test_one_shuffle_serves_all_of_mack(raa):
    plan = mk.mack_totals(raa, K, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_tweedie_options(raa):
    cl = ultimates(methods.chain_ladder(raa, K, 12))
    assert ultimates(fits.tweedie_glm(raa, K, 1.0, projection="increments")) == pytest.approx(cl, rel=1e-6)
    assert fits.tweedie_glm(raa, K, 1.0, negative="refuse").first()["error"] == "Refusal: negative_increment: power 1"
    trend = fits.tweedie_glm(raa, K, 1.0, origin="none", calendar="trend")
    assert trend.where("error is null").count() == 10
    normal = fits.tweedie_glm(raa, K, 0.0, link="identity")
    assert normal.where("error is null").count() == 10
    for bad in ({"power": 0.5}, {"calendar": "trend"}, {"origin": "none", "projection": "increments"}, {"link": "probit"}):
        with pytest.raises(Refusal):
            fits.tweedie_glm(raa, K, **bad)


def test_weighted_residuals_vanish(raa):
    """The score equations at power 1: fitted and observed increments agree by origin and by age."""
    cum = simulate.matrix(raa.toPandas())[2]
    fitted, _ = fits.Tweedie(1.0).fit(cum)
    inc = np.diff(np.concatenate([np.zeros((10, 1)), cum], axis=1), axis=1)
    off = np.where(np.isnan(inc), 0, inc - fitted)
    assert np.abs(off.sum(axis=0)).max() < 1e-5 and np.abs(off.sum(axis=1)).max() < 1e-5


def test_leverage_and_pools(raa):
    cum = simulate.matrix(raa.toPandas())[2]
    fit = simulate.odp_fit(cum)
    m, seen = fit["fitted"], fit["seen"]
    i, j = np.nonzero(seen)
    x = np.hstack([i[:, None] == np.arange(10), j[:, None] == np.arange(1, 10)]).astype(float)
    w = np.abs(m[seen])
    direct = np.diag(x @ np.linalg.inv(x.T @ (x * w[:, None])) @ (x.T * w))
    h = simulate.odp_leverage(np.where(seen, np.abs(m), 0))
    assert h[seen] == pytest.approx(direct) and h[seen].sum() == pytest.approx(19)
    corners = {(0, 9), (9, 0)}
    assert {(a, b) for a, b in np.argwhere(np.nan_to_num(h) > simulate.LEVERAGE_ONE)} == corners
    assert len(fit["pool"]) == 55 and len(simulate.odp_fit(cum, simulate.Bootstrap(pool="centred"))["pool"]) == 53
    hat = simulate.odp_fit(cum, simulate.Bootstrap(adjustment="hat", pool="centred"))["pool"]
    assert hat.mean() == pytest.approx(0, abs=1e-9)
    with pytest.raises(Refusal):
        simulate.odp_fit(cum, simulate.Bootstrap(negative="refuse"))
    zero = np.array([[100.0, 150, 170, 175], [90, 140, 140, np.nan], [80, 110, np.nan, np.nan], [70, np.nan, np.nan, np.nan]])
    assert len(simulate.odp_fit(zero, simulate.Bootstrap(pool="centred"))["pool"]) == 8


def test_bootstrap_methods_centre_on_theirs(raa, premium):
    for method, options, point in (
        ("bf", {"expected_loss_ratio": 0.6}, methods.bornhuetter_ferguson(raa, premium, K, 12, 0.6)),
        ("benktander", {"expected_loss_ratio": 0.6, "n_iters": 2}, methods.benktander(raa, premium, K, 12, 0.6, n_iters=2)),
        ("gcc", {"decay": 0.75}, methods.cape_cod(raa, premium, K, 12, decay=0.75)),
    ):
        draws = simulate.odp_bootstrap(raa, K, n_draws=2000, seed=5, premium=premium, method=method, **options)
        mean = draws.groupBy("draw").agg(F.sum("value").alias("v")).agg(F.avg("v")).first()[0]
        assert mean == pytest.approx(point.agg(F.sum("ibnr")).first()[0], rel=0.08)
    narrow = simulate.odp_bootstrap(raa, K, n_draws=2000, seed=5, premium=premium, method="bf", expected_loss_ratio=0.6, process="none")
    wide = simulate.odp_bootstrap(raa, K, n_draws=2000, seed=5, premium=premium, method="bf", expected_loss_ratio=0.6, process="none", prior_cv=0.5)
    sd = [d.groupBy("draw").agg(F.sum("value").alias("v")).agg(F.stddev("v")).first()[0] for d in (narrow, wide)]
    assert sd[1] > 1.5 * sd[0]
    assert simulate.odp_bootstrap(raa, K, n_draws=100, negative="refuse").count() == 0
    assert simulate.odp_scale(raa, K, negative="refuse").first()["error"] == "negative_increment"
    with pytest.raises(Refusal):
        simulate.odp_bootstrap(raa, K, prior_cv=0.1)
