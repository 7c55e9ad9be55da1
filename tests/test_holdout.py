"""Places of held-out cells in a fit's grid, and totals over lines within draws."""

from datetime import date

import pytest
from fixtures_triangles import frame
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.operators import holdout, multiline

K = ["lob"]


def test_places_predecessors_and_reasons(spark):
    train = frame(spark, {2018: (100, 150, 170), 2019: (110, 160), 2020: (90,)})
    hole = train.where("not (year(origin_period) = 2018 and dev_lag = 24)")
    index = holdout.training_index(hole, K, 12)
    got = {(r["origin_period"].year, r["dev_lag"]): (r["w"], r["d"], r["prev_value"]) for r in index.collect()}
    assert got[2018, 12] == (1, 1, 0.0) and got[2018, 36] == (1, 3, None) and got[2019, 24] == (2, 2, 110.0) and got[2020, 12] == (3, 1, 0.0)
    cells = [("auto", date(2019, 1, 1), 36, 1.0), ("auto", date(2020, 1, 1), 24, 2.0), ("auto", date(2021, 1, 1), 12, 3.0), ("auto", date(2018, 1, 1), 48, 4.0), ("home", date(2019, 1, 1), 12, 5.0), ("auto", date(2020, 1, 1), 30, 6.0), ("auto", date(2019, 1, 1), 12, 7.0), ("auto", date(2019, 1, 1), 12, 8.0)]
    held = spark.createDataFrame(cells, "lob string, origin_period date, dev_lag bigint, value double")
    out = {r["value"]: (r["w"], r["d"], r["prev_value"], r["reason"]) for r in holdout.index_into(held, index, K, 12).collect()}
    assert out == {
        1.0: (2, 3, 160.0, None), 2.0: (3, 2, 90.0, None), 3.0: (None, None, None, "unknown_origin"), 4.0: (None, None, None, "dev_beyond_trained"),
        5.0: (None, None, None, "unknown_cohort"), 6.0: (None, None, None, "off_grain"), 7.0: (None, None, None, "duplicate"), 8.0: (None, None, None, "duplicate"),
    }
    assert holdout.index_into(held.limit(0), index, K, 12).count() == 0


def test_training_cells_that_cannot_be_told_apart_are_refused(spark):
    train = frame(spark, {2018: (100, 150)})
    with pytest.raises(Refusal, match="duplicate"):
        holdout.training_index(train.union(train), K, 12)
    with pytest.raises(Refusal, match="off_grain"):
        holdout.training_index(train.withColumn("dev_lag", F.col("dev_lag") + 1), K, 12)


def test_keys_are_narrowed_only_where_no_cohorts_meet(spark):
    cells = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 3), (None, "z", 4)], "lob string, company string, value int")
    assert sorted(holdout.narrowed_to(cells, ["lob", "company"], ["company"]).columns) == ["company", "value"]
    more = cells.union(spark.createDataFrame([("c", "x", 5)], cells.schema))
    with pytest.raises(Refusal, match="keys_collapse"):
        holdout.narrowed_to(more, ["lob", "company"], ["company"])
    assert [(r["company"], r["n_cohorts"], r["example"]) for r in holdout.collapsed(more, ["lob", "company"], ["company"]).collect()] == [("x", 2, ["a/x", "c/x"])]


DRAWS = "company string, lob string, origin_period date, draw int, value double"


def test_totals_are_sums_within_draws(spark):
    rows = [("c", lob, date(2018 + w, 1, 1), n, float(10 * w + n * (1 if lob == "a" else -1))) for lob in "ab" for w in range(2) for n in range(4)]
    draws = spark.createDataFrame(rows, DRAWS)
    out = {(r["label"], r["draw"]): r["value"] for r in multiline.with_totals(draws, ["company"], "lob").collect()}
    assert out["a/total", 3] == 16.0 and out["b/total", 3] == 4.0 and len(out) == 28
    # Lines that move against each other: every draw of the total is the same.
    assert {out["total", n] for n in range(4)} == {20.0} and out["a/2019-01-01", 2] == 12.0
    spread = {r["label"]: r["sd"] for r in multiline.target_summary(multiline.with_totals(draws, ["company"], "lob"), ["company"]).collect()}
    assert spread["total"] == 0.0 and spread["a/total"] > 0
    unknown = draws.withColumn("value", F.when((F.col("lob") == "a") & (F.col("draw") == 1), F.lit(None)).otherwise(F.col("value")))
    lost = {(r["label"], r["draw"]): r["value"] for r in multiline.with_totals(unknown, ["company"], "lob").collect()}
    assert lost["a/total", 1] is None and lost["total", 1] is None and lost["b/total", 1] == 8.0 and lost["total", 2] == 20.0


def test_lines_without_all_draws_are_refused(spark):
    rows = [("c", lob, date(2018 + w, 1, 1), n, 1.0) for lob in "ab" for w in range(2) for n in range(3)]
    draws = spark.createDataFrame(rows, DRAWS)
    bad = draws.where("not (lob = 'b' and year(origin_period) = 2019)").where("not (lob = 'a' and year(origin_period) = 2018 and draw = 2)")
    assert {(r["lob"], r["origin_period"].year, r["reason"]) for r in multiline.unaligned_draws(bad, ["company"], "lob").collect()} == {("b", 2019, "missing_line"), ("a", 2018, "missing_draws")}
    with pytest.raises(Refusal, match="missing"):
        multiline.with_totals(bad, ["company"], "lob")
    with pytest.raises(Refusal, match="duplicate"):
        multiline.with_totals(draws.union(draws.limit(1)), ["company"], "lob")


def test_misaligned_and_single_lines(spark):
    cells = frame(spark, {2018: (1, 2), 2019: (1,)}).withColumn("company", F.lit("c"))
    other = frame(spark, {2018: (1, 2), 2019: (1, 2)}, "home").withColumn("company", F.lit("c"))
    lone = frame(spark, {2018: (1,)}, "solo").withColumn("company", F.lit("d"))
    found = {(r["company"], r["lob"]): (r["n_missing"], r["n_extra"], r["reason"]) for r in multiline.misaligned(cells.union(other).union(lone), ["company"], "lob").collect()}
    assert found == {("c", "home"): (0, 1, "misaligned"), ("d", "solo"): (0, 0, "single_line")}
    assert multiline.misaligned(cells.union(other.where("not (year(origin_period) = 2019 and dev_lag = 24)")), ["company"], "lob").count() == 0
