"""Retrospectives: stages, gates, resumption."""

import pytest
from fixtures_triangles import RAA, frame
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.operators import retro
from rundelta.operators.backtest import Candidate

K = ["lob"]
DAYS = ["1986-12-31", "1990-12-31"]


@pytest.fixture(scope="module")
def cells(spark):
    return frame(spark, RAA).unionByName(frame(spark, {1985: (10,), 1990: (20,)}, "thin"))


def counted(fit, calls):
    def run(cells, keys):
        calls.append(sorted((r["lob"], str(r["snapshot"])) for r in cells.select(*keys).distinct().collect()))
        return fit(cells, keys)

    return run


def test_a_stage_reads_only_what_failed_and_a_study_goes_on(spark, cells, tmp_path):
    premium = cells.select("lob", "origin_period").distinct().withColumn("premium", F.lit(1.0))
    first, second = [], []
    stages = [counted(retro.mack_stage(12), first), counted(retro.candidate_stage(premium, Candidate("cl", "cl"), 12, 60), second)]
    gates = retro.Gates(max_cv=0.13)
    folder = str(tmp_path / "study")
    out = {(r["lob"], str(r["snapshot"])): r for r in retro.run_retro(cells, K, DAYS, stages, gates, folder).collect()}
    everything = [("auto", "1986-12-31"), ("auto", "1990-12-31"), ("thin", "1986-12-31"), ("thin", "1990-12-31")]
    assert first == [everything] and sorted(out) == everything
    whole = out["auto", "1990-12-31"]
    assert (whole["stage"], whole["passed"]) == (1, True) and whole["estimate"] == pytest.approx(213122.228, rel=1e-6) and whole["se"] == pytest.approx(26880.74, rel=1e-6)
    assert second == [[k for k in everything if k != ("auto", "1990-12-31")]]
    assert all(out[k]["stage"] == 2 and not out[k]["passed"] for k in everything if k[0] == "thin") and out["thin", "1990-12-31"]["reason"] == "no_link_ratio"
    # Whole folders are read back: no stage runs again; a stage that was cut off does.
    again = retro.run_retro(cells, K, DAYS, stages, gates, folder).collect()
    assert len(again) == 4 and len(first) == len(second) == 1
    (tmp_path / "study" / "stage-2" / "_SUCCESS").unlink()
    assert len(retro.run_retro(cells, K, DAYS, stages, gates, folder).collect()) == 4 and (len(first), len(second)) == (1, 2)


def test_outcomes_are_known_whole_or_not(spark, cells):
    rows = spark.createDataFrame([("auto", "1984-12-31"), ("auto", "1990-12-31")], "lob string, snapshot string").withColumn("snapshot", F.col("snapshot").cast("date"))
    got = {str(r["snapshot"]): r["outcome"] for r in retro.with_outcomes(rows, cells, K, 60).collect()}
    assert got == {"1984-12-31": float(RAA[1981][4] + RAA[1982][4] + RAA[1983][4] + RAA[1984][4]), "1990-12-31": None}


def test_no_stage_and_no_cells(spark, cells):
    with pytest.raises(Refusal):
        retro.run_retro(cells, K, DAYS, [])
    assert retro.run_retro(cells.limit(0), K, DAYS, [retro.mack_stage(12)]).count() == 0
