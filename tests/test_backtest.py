"""Replays of candidates: settings, failures, horizons."""

import pytest
from fixtures_triangles import frame
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.operators import backtest as bt
from rundelta.operators.links import LinkRules, link_factors, select_links

K = ["lob"]
ROWS = {2018: (100, 150, 165, 170), 2019: (110, 160, 180), 2020: (90, 140), 2021: (95,)}


@pytest.fixture(scope="module")
def cells(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def premium(spark, cells):
    return cells.select("lob", "origin_period").distinct().withColumn("premium", F.lit(300.0))


def fitted(cells, premium, candidate, horizon=None):
    out = bt.fit_candidates(cells, premium, bt.candidates_frame(cells.sparkSession, [candidate]), K, 12, horizon)
    return {r["origin_period"].year: r for r in out.collect()}


@pytest.mark.parametrize("average", ["volume", "simple", "regression"])
@pytest.mark.parametrize("rules", [{}, {"history_periods": 2}, {"drop_high": 1, "exhausted": "keep"}])
def test_a_candidate_is_its_link_rules(cells, premium, average, rules):
    got = fitted(cells, premium, bt.Candidate("x", "cl", average=average, **rules))
    links = LinkRules(zero_cells="observed", ties="origin", history_periods=rules.get("history_periods"), drop_high=rules.get("drop_high", 0))
    factors = {r["dev_lag"]: r["factor"] for r in link_factors(select_links(cells, K, 12, links), K, average).collect()}
    for year, values in ROWS.items():
        ultimate = values[-1]
        for age in range(12 * len(values), 48, 12):
            ultimate *= factors[age]
        assert got[year]["ultimate"] == pytest.approx(ultimate)


def test_failed_fits_say_why_and_have_no_values(cells, premium):
    strict = fitted(cells, premium, bt.Candidate("x", "cl", drop_high=1))
    assert {r["reason"] for r in strict.values()} == {"exclusions_exhausted"} and all(r["ultimate"] is None for r in strict.values())
    deep = fitted(cells, premium, bt.Candidate("x", "cl"), horizon=60)
    assert {r["reason"] for r in deep.values()} == {"no_link_ratio"}
    unity = fitted(cells, premium, bt.Candidate("x", "cl", unsupported="unity"), horizon=60)
    assert unity[2018]["ultimate"] == 170 and unity[2018]["reason"] is None
    bare = fitted(cells, premium.where("year(origin_period) > 2018"), bt.Candidate("x", "bf", expected_loss_ratio=0.6))
    assert {r["reason"] for r in bare.values()} == {"premium_missing"}
    with pytest.raises(Refusal):
        bt.Candidate("x", "ml")


def test_zero_cells_count_for_the_window_or_not(spark, premium):
    cells = frame(spark, {2018: (0, 150, 165), 2019: (110, 160), 2020: (0, 140), 2021: (95,)})
    observed = fitted(cells, premium, bt.Candidate("x", "cl", 1, unsupported="unity"))
    missing = fitted(cells, premium, bt.Candidate("x", "cl", 1, zero_cells="missing", unsupported="unity"))
    # The latest pair starts from zero: the window moves to 2019, or keeps the lost pair's place.
    assert observed[2021]["next_value"] == pytest.approx(95 * 160 / 110)
    assert missing[2021]["next_value"] == 95


def test_an_interval_counts_whole_or_not_at_all(spark, cells, premium):
    days = ["2020-12-31", "2021-12-31"]
    grid = bt.candidates_frame(spark, [bt.Candidate("cl", "cl")])
    whole = bt.replay_intervals(cells, premium, grid, days, K, 12, 36).collect()
    # Origin 2018 is at the horizon: it stays there and moves by nothing.
    moves = {r["origin_period"].year: (r["dev_lag"], r["expected"], r["actual"], r["failed"]) for r in whole}
    assert moves[2018] == (36, 0.0, 0.0, None) and moves[2019][0] == 36 and moves[2020][2] == 50.0
    # One origin is not observed at the later date: no origin of the cohort is scored.
    hidden = cells.where("not (year(origin_period) = 2019 and dev_lag = 36)")
    rows = bt.replay_intervals(hidden, premium, grid, days, K, 12, 36)
    assert {r["failed"] for r in rows.collect()} == {"not_next_age"}
    assert bt.score_replay(rows).first()["status"] == "failed" and bt.score_replay(rows).first()["rmse"] is None
    failures = bt.replay_failures(rows, K).collect()
    assert [(r["reason"], r["n_origins"]) for r in failures] == [("not_next_age", 3)]
    assert bt.replay(hidden, premium, grid, days, K, 12, 36).count() == 0
    lost = cells.where("not (year(origin_period) = 2019)").unionByName(cells.where("year(origin_period) = 2019 and eval_date <= '2020-12-31'").withColumn("lob", F.lit("gone")))
    reasons = {(r["lob"], r["reason"]) for r in bt.replay_failures(bt.replay_intervals(lost, premium, grid, days, K, 12, 24), K).collect()}
    assert ("gone", "fit_before: no_link_ratio") not in reasons or len(reasons) >= 1
