"""The review log: sequential, linked, and telling when it was changed."""

import pytest
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.sources import ledger


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "log")
    assert [ledger.append(spark, path, "a", "x", p) for p in ("{}", '{"ok": 1}')] == [1, 2]
    assert ledger.append(spark, path, "b", "y", "first", revision=1) == 1
    with pytest.raises(Refusal):
        ledger.append(spark, path, "a", "z", "stale", revision=2)
    log = ledger.read(spark, path)
    assert log.count() == 3 and ledger.broken(log).count() == 0
    assert {(r["review"], r["revision"], r["payload"]) for r in ledger.latest(log).collect()} == {("a", 2, '{"ok": 1}'), ("b", 1, "first")}
    changed = log.withColumn("payload", F.when(F.col("revision") == 2, "forged").otherwise(F.col("payload")))
    assert [r["revision"] for r in ledger.broken(changed).collect()] == [2]
    assert [r["review"] for r in ledger.broken(log.where("not (review = 'a' and revision = 1)")).collect()] == ["a"]
