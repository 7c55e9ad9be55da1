from datetime import date

import pytest
from fixtures_triangles import SCHEMA, SMALL, frame, rows
from pyspark.sql import functions as F

from rundelta.errors import Refusal, require_none
from rundelta.operators.triangle import Triangle, TriangleMeta, read_triangle, run_off_violations, write_triangle


def values(t, *by):
    return {tuple(r[c] for c in by): r["value"] for r in t.df.collect()}


def test_increments_and_back(spark):
    t = Triangle(frame(spark, SMALL))
    inc = t.to_incremental()
    assert values(inc.filter("year(origin_period) = 2020"), "dev_lag") == {(12,): 100, (24,): 50, (36,): 25}
    assert values(inc.to_cumulative(), "origin_period", "dev_lag") == values(t, "origin_period", "dev_lag")
    assert t.to_cumulative() is t and inc.to_incremental() is inc


def test_gap_drops_the_increment(spark):
    t = Triangle(spark.createDataFrame([r for r in rows(SMALL) if not (r[1].year == 2020 and r[2] == 24)], SCHEMA))
    assert (date(2020, 1, 1), 36) not in values(t.to_incremental(), "origin_period", "dev_lag")


def test_as_of_and_diagonal(spark):
    t = Triangle(frame(spark, SMALL))
    assert t.as_of("2021-12-31").df.count() == 3
    assert values(t.latest_diagonal(), "dev_lag") == {(36,): 175, (24,): 165, (12,): 120}


def test_restatement_replaces_and_ties_stay(spark):
    extra = [("auto", date(2020, 1, 1), 12, date(2021, 6, 30), "paid_loss", 95.0)]
    t = Triangle(spark.createDataFrame(rows(SMALL) + extra, SCHEMA))
    assert values(t.as_of("2021-06-30"), "origin_period", "dev_lag")[(date(2020, 1, 1), 12)] == 95
    tied = Triangle(spark.createDataFrame(rows(SMALL) + [("auto", date(2020, 1, 1), 12, date(2020, 12, 31), "paid_loss", 1.0)], SCHEMA))
    assert tied.as_of("2020-12-31").df.count() == 2
    with pytest.raises(Refusal, match="duplicate"):
        tied.to_wide("paid_loss", [12])


def test_quarterly_to_yearly_development(spark):
    ends = [date(2020, 3, 31), date(2020, 6, 30), date(2020, 9, 30), date(2020, 12, 31), date(2021, 3, 31), date(2021, 6, 30), date(2021, 9, 30), date(2021, 12, 31)]
    data = [("auto", date(2020, 1, 1), 3 * (n + 1), e, "paid_loss", float(v)) for n, (e, v) in enumerate(zip(ends, (10, 30, 45, 50, 58, 64, 67, 70), strict=True))]
    t = Triangle(spark.createDataFrame(data, SCHEMA), TriangleMeta("Y", "Q"))
    assert values(t.with_dev_grain("Y"), "dev_lag") == {(12,): 50, (24,): 70}
    assert values(t.to_incremental().with_dev_grain("Y"), "dev_lag") == {(12,): 50, (24,): 20}
    with pytest.raises(Refusal, match="grain_mismatch"):
        Triangle(t.df).with_dev_grain("M")


def test_findings(spark):
    clean = Triangle(frame(spark, SMALL))
    assert clean.validate() == []
    assert Triangle(spark.createDataFrame([], SCHEMA)).validate() == []
    spoilt = rows(SMALL) + [rows(SMALL)[0], ("auto", date(2021, 1, 1), 13, date(2021, 12, 31), "paid_loss", 1.0)]
    found = {r["check"]: r["n"] for r in Triangle(spark.createDataFrame(spoilt, SCHEMA)).findings_frame().collect()}
    assert found["duplicate_cells"] == 1 and found["eval_alignment"] == 1 and found["dev_lag_on_grain"] == 1
    with pytest.raises(Refusal, match="invalid_table"):
        Triangle(spark.createDataFrame(spoilt, SCHEMA)).validate(strict=True)


def test_anchored_offsets_are_legal(spark):
    data = [("auto", date(2020, 1, 1), 3 + 12 * n, date(2020 + n, 3, 31), "paid_loss", 1.0) for n in range(3)]
    assert Triangle(spark.createDataFrame(data, SCHEMA)).validate() == []


def test_null_segments_are_refused(spark):
    df = frame(spark, SMALL).withColumn("lob", F.when(F.col("dev_lag") > 12, F.col("lob")))
    with pytest.raises(Refusal, match="missing_value"):
        Triangle.from_long(df)


def test_from_long_unpivots_and_scales(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1, date(2020, 12, 31), 5.0, None)], "lob string, o date, d int, e date, paid double, open double")
    t = Triangle.from_long(df, origin="o", dev="d", eval_date="e", fields=["paid", "open"], dev_lag_unit="periods")
    assert [(r["field"], r["dev_lag"], r["value"]) for r in t.df.collect()] == [("paid", 12, 5.0)]
    assert t.segments == ["lob"] and t.fields() == ["paid"]


def test_run_off(spark):
    df = frame(spark, SMALL)
    assert run_off_violations(df, ["lob"], 12).count() == 0
    assert run_off_violations(df.where("not (year(origin_period) = 2020 and dev_lag = 24)"), ["lob"], 12).count() == 1


def test_triangle_survives_parquet(spark, tmp_path):
    t = Triangle(frame(spark, SMALL), TriangleMeta("Y", "Y", "cumulative", "thousands"))
    write_triangle(t, str(tmp_path / "t"))
    again = read_triangle(spark, str(tmp_path / "t"))
    assert again.meta == t.meta and again.df.count() == 6


def test_refusals_as_rows(spark):
    require_none(spark.createDataFrame([], "reason string"))
    with pytest.raises(Refusal) as e:
        require_none(spark.createDataFrame([("no_link_ratio", 12)], "reason string, dev_lag int"))
    assert e.value.kind == "model"


def test_front_doors_agree(spark):
    from rundelta.operators.triangle import inferred_step, peek_kind

    t = Triangle(frame(spark, SMALL))
    columns = {c: [r[c] for r in t.df.collect()] for c in t.df.columns}
    again = Triangle.from_columns(spark, columns)
    assert sorted(map(tuple, again.df.select(t.df.columns).collect())) == sorted(map(tuple, t.df.collect()))
    wide = t.df.groupBy("lob", "origin_period").pivot("dev_lag", [12, 24, 36]).agg(F.sum("value"))
    assert sorted(map(tuple, Triangle.from_wide(wide, segments=["lob"]).df.select(t.df.columns).collect())) == sorted(map(tuple, t.df.collect()))
    table = t.to_incremental().to_arrow()
    assert peek_kind(table) == "triangle" and peek_kind(table.replace_schema_metadata(None)) is None
    back = Triangle.from_arrow(spark, table)
    assert back.meta.measure == "incremental" and back.df.count() == 6
    with pytest.raises(Refusal):
        Triangle.from_arrow(spark, table.replace_schema_metadata(None))
    with pytest.raises(Refusal):
        Triangle.from_wide(wide.withColumnRenamed("12", "first"), segments=["lob"])
    assert inferred_step(t.df, ["lob"]).first()["step"] == 12
    s = t.summary().first()
    assert (s["n_cells"], s["n_cohorts"], s["n_origins"], s["n_ages"], s["last_dev_lag"]) == (6, 1, 3, 3, 36)


def test_unsupported_factors(spark):
    from rundelta.operators.links import link_factors, select_links

    links = select_links(frame(spark, {2020: (0, 10, 20), 2021: (0, 12), 2022: (5,)}), ["lob"], 12)
    assert link_factors(links, ["lob"], unsupported="null").where("dev_lag = 12").first()["factor"] is None
    with pytest.raises(Refusal) as e:
        link_factors(links, ["lob"], unsupported="raise")
    assert e.value.reason == "no_link_ratio"
