"""Developments with a tail as ages of their own."""

import math

import pytest
from fixtures_triangles import RAA, frame

from rundelta.errors import Refusal
from rundelta.operators import development as dev
from rundelta.operators import methods
from rundelta.operators.links import link_factors, select_links

K = ["lob"]


@pytest.fixture(scope="module")
def raa(spark):
    return frame(spark, RAA)


@pytest.fixture(scope="module")
def factors(raa):
    return link_factors(select_links(raa, K, 12), K)


def rows(factors, tail):
    return sorted(dev.development(factors, K, 12, tail).collect(), key=lambda r: r["dev_lag"])


def test_a_tail_past_the_data_is_the_constant_tail(raa, factors):
    got = rows(factors, dev.Tail(constant=1.08, rows=12))
    assert [r["source"] for r in got] == ["data"] * 9 + ["tail"] * 12 and got[9]["dev_lag"] == 120
    steps = methods.constant_tail_steps(1.08, 12)
    assert [r["factor"] for r in got[9:]] == pytest.approx(steps) and got[9]["cdf"] == pytest.approx(1.08)
    total = sum(r["ultimate"] for r in dev.projected(raa, dev.development(factors, K, 12, dev.Tail(constant=1.08)), K).collect())
    assert total == pytest.approx(1.08 * 213122.22826121017)


def test_an_earlier_attachment_replaces_links_and_shows_every_age(raa, factors):
    got = rows(factors, dev.Tail(constant=1.2, attach_lag=60))
    assert [(r["dev_lag"], r["source"]) for r in got] == [(12 * n, "data") for n in range(1, 5)] + [(12 * n, "tail") for n in range(5, 11)]
    assert math.prod(r["factor"] for r in got[4:]) == pytest.approx(1.2) and got[-1]["factor"] > 1
    found = {r["latest_dev"]: r["ultimate"] / r["latest"] for r in dev.projected(raa, dev.development(factors, K, 12, dev.Tail(constant=1.2, attach_lag=60)), K).collect()}
    assert found[60] == pytest.approx(1.2) and found[120] == pytest.approx(got[-1]["factor"]) and found[12] == pytest.approx(got[0]["cdf"])


@pytest.mark.parametrize("curve", ["exponential", "inverse_power", "weibull"])
def test_a_curve_is_the_curve_tail_whatever_the_rows(factors, curve):
    whole = methods.curve_tail(factors, K, 12, curve).first()["tail_factor"]
    for n in (1, 4):
        got = [r["factor"] for r in rows(factors, dev.Tail(curve=curve, rows=n)) if r["source"] == "tail"]
        assert len(got) == n and math.prod(got) == pytest.approx(whole, rel=1e-9)


def test_failed_tails_leave_the_data_and_say_why(spark, factors):
    growing = link_factors(select_links(frame(spark, {2018: (10, 11, 14, 30), 2019: (10, 11, 14), 2020: (10, 11)}), K, 12), K)
    assert {(r["source"], r["reason"]) for r in rows(growing, dev.Tail(curve="exponential"))} == {("data", "tail_not_decaying")}
    assert {(r["source"], r["reason"]) for r in rows(factors, dev.Tail(constant=1.1, attach_lag=240))} == {("data", "not_supported")}
    assert rows(factors.limit(0), dev.Tail(constant=1.1)) == []
    for bad in ({"constant": 1.1, "curve": "weibull"}, {}, {"constant": 0.0}, {"curve": "line"}, {"constant": 1.1, "rows": 0}):
        with pytest.raises(Refusal):
            dev.Tail(**bad)
