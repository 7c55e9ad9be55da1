"""Line items are read and joined once a query, whatever reads the triangle after."""

import shutil

import pytest

from rundelta.plans import catalogue
from rundelta.sources import marts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def vanishing(spark, tmp_path, monkeypatch):
    """Tables whose line items are gone as soon as the sums of the triangle are kept."""
    for t in ("customer", "orders", "lineitem"):
        shutil.copy(f"{FOLDER}/{t}.parquet", tmp_path)
    keep = marts.kept

    def once(df, tag):
        out = keep(df, tag)
        if tag == "increments":
            (tmp_path / "lineitem.parquet").unlink()
        return out

    monkeypatch.setattr(marts, "kept", once)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["calibration_pools", "ml_boosting", "artifact_digest", "ml_forest", "sur_draws", "sur_two_lines", "retrospective", "cutoff_features"])
def test_line_items_are_read_once(spark, vanishing, name):
    assert catalogue.queries()[name](spark, vanishing).count() > 0
