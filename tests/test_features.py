"""Features at cutoffs: nothing from after a cutoff reaches its row."""

from datetime import date

import pytest
from fixtures_triangles import frame
from pyspark.sql import functions as F

from rundelta.operators import features
from rundelta.operators.backtest import known_at
from rundelta.operators.links import link_factors, select_links

K = ["lob"]
ROWS = {2018: (100, 150, 165), 2019: (110, 160), 2020: (90,)}


def rows(df, cutoff=None):
    out = {(str(r["cutoff"]), r["dev_lag"]): tuple(r)[3:] for r in features.cutoff_features(df, K, 12).collect()}
    return out if cutoff is None else {k: v for k, v in out.items() if k[0] == cutoff}


@pytest.fixture(scope="module")
def cells(spark):
    again = [("auto", date(2018, 1, 1), 12, date(2020, 12, 31), "paid_loss", 104.0), ("auto", date(2018, 1, 1), 24, date(2020, 12, 31), "paid_loss", 140.0)]
    first = frame(spark, ROWS)
    return first.unionByName(spark.createDataFrame(again, first.schema))


def test_each_cutoff_knows_what_was_valued_by_then(cells):
    got = rows(cells)
    for day in ("2018-12-31", "2019-12-31", "2020-12-31"):
        known = known_at(cells, K, day)
        factors = {r["dev_lag"]: (r["factor"], r["n_selected"]) for r in link_factors(select_links(known, K, 12), K).collect()}
        for age in (12, 24):
            n, factor = got[day, age][0], got[day, age][1]
            assert (factor, n) == (pytest.approx(factors[age][0]), factors[age][1]) if age in factors else (factor, n) == (None, 0)
    assert got["2020-12-31", 24][2:4] == (3, pytest.approx(104 + 110 + 140))
    assert got["2020-12-31", 12][5] == pytest.approx((140 + 160) / (104 + 110) * 165 / 140)
    assert got["2020-12-31", 12][4] == pytest.approx(300 / 214 - 150 / 100)


def test_hidden_cells_change_nothing(cells):
    seen = rows(cells, "2019-12-31")
    changed = cells.withColumn("value", F.when(F.col("eval_date") > "2019-12-31", F.col("value") * 7 + 1).otherwise(F.col("value")))
    assert rows(changed, "2019-12-31") == seen
    gone = cells.where("eval_date <= '2019-12-31'")
    # Ages that only later cells open have no rows yet; all others are the same.
    assert {k: v for k, v in seen.items() if v[0] > 0} == {k: v for k, v in rows(gone, "2019-12-31").items() if v[0] > 0}
    assert rows(cells.limit(0)) == {}
