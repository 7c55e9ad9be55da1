"""Typed artifacts: round trips, kinds without data, digests."""

import numpy as np
import pytest
from fixtures_triangles import RAA, frame

from rundelta.errors import Refusal
from rundelta.operators import mack as mk
from rundelta.sources import artifacts

K = ["lob", "origin"]


@pytest.fixture(scope="module")
def draws(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(lob, o, n, float(rng.normal())) for lob in "ab" for o in range(3) for n in range(5, 25)], "lob string, origin int, draw int, value double")


def test_draws_round_trip_and_digest(spark, draws, tmp_path):
    path = artifacts.save(artifacts.pack_draws(draws, K), str(tmp_path / "draws"), "draws", K)
    assert artifacts.peek_kind(spark, path) == ("draws", 1, K)
    back, keys = artifacts.load(spark, path, "draws")
    assert sorted(map(tuple, artifacts.unpack_draws(back, keys).collect())) == sorted(map(tuple, draws.collect()))
    for r in artifacts.digest(back, keys).collect():
        x = np.array([d["value"] for d in draws.collect() if (d["lob"], d["origin"]) == (r["lob"], r["origin"])])
        assert (r["n"], r["least"], r["most"]) == (20, x.min(), x.max())
        assert np.allclose([r["mean"], r["q05"], r["q50"], r["q95"]], [x.mean(), *np.quantile(x, [0.05, 0.5, 0.95])])
    with pytest.raises(Refusal, match="holds draws, not mack"):
        artifacts.load(spark, path, "mack")


def test_fits_and_panels_round_trip(spark, tmp_path):
    fit = mk.mack_factors(frame(spark, RAA), ["lob"], 12)
    back, keys = artifacts.load(spark, artifacts.save(fit, str(tmp_path / "mack"), "mack", ["lob"]))
    assert keys == ["lob"] and sorted(map(str, back.select(fit.columns).collect())) == sorted(map(str, fit.collect()))
    panel = spark.createDataFrame([("m", "c1", -1.5), ("n", "c1", None)], "model string, cell string, score double")
    back, keys = artifacts.load(spark, artifacts.save(panel, str(tmp_path / "panel"), "panel", ["cell"]), "panel")
    assert back.columns == ["cell", "model", "score"] and back.count() == 2


def test_what_is_no_artifact_or_not_whole_is_refused(spark, draws, tmp_path):
    plain = str(tmp_path / "plain")
    draws.write.parquet(plain)
    with pytest.raises(Refusal, match="no artifact"):
        artifacts.peek_kind(spark, plain)
    with pytest.raises(Refusal, match="invalid_table"):
        artifacts.save(draws, str(tmp_path / "x"), "draws", K)
    with pytest.raises(Refusal, match="invalid_option"):
        artifacts.save(draws, str(tmp_path / "x"), "other", K)
    with pytest.raises(Refusal, match="missing_draws"):
        artifacts.pack_draws(draws.where("not (lob = 'a' and draw = 9)"), K)
    with pytest.raises(Refusal, match="from 19 to 20"):
        artifacts.pack_draws(draws.where("not (lob = 'a' and draw = 24)"), K)
