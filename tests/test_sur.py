"""Seemingly unrelated regressions: points against numpy, draws against the covariance that they are drawn from."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from rundelta.functions.linear import cholesky, inverse, positive, solved
from rundelta.operators import sur
from rundelta.plans import catalogue
from rundelta.sources import marts

K = ["company"]
SCHEMA = "company string, lob string, origin_period date, dev_lag bigint, value double"


def company(spark, n_full: int, seed: int = 1, name: str = "c"):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_full + 1):
        x = rng.uniform(80, 120, 2)
        e = rng.multivariate_normal([0, 0], [[0.4, 0.25], [0.25, 0.3]])
        for l, lob in enumerate(("a", "b")):
            rows.append((name, lob, date(1950 + i, 1, 1), 12, float(x[l])))
            if i < n_full:
                rows.append((name, lob, date(1950 + i, 1, 1), 24, float(x[l] * (1.5, 1.2)[l] + np.sqrt(x[l]) * e[l])))
    return spark.createDataFrame(rows, SCHEMA)


def fgls(x, y, rounds):
    root = np.sqrt(x)
    b = (y.sum(axis=1) / x.sum(axis=1))
    for _ in range(rounds):
        r = (y - b[:, None] * x) / root
        sigma = r @ r.T / (x.shape[1] - 1)
        w = np.linalg.inv(sigma)
        a = w * (root @ root.T)
        v = (w * np.array([[(root[p] * y[q] / root[q]).sum() for q in range(2)] for p in range(2)])).sum(axis=1)
        b = np.linalg.solve(a, v)
    r = (y - b[:, None] * x) / root
    sigma = r @ r.T / (x.shape[1] - 1)
    return b, sigma, np.linalg.inv(np.linalg.inv(sigma) * (root @ root.T))


def test_algebra_in_sql(spark):
    rng = np.random.default_rng(2)
    for k in (1, 2, 5):
        a = rng.normal(size=(k, k))
        m, b = a @ a.T + np.eye(k), rng.normal(size=k)
        row = spark.createDataFrame([(m.tolist(), b.tolist(), k)], "m array<array<double>>, b array<double>, k int")
        got = row.select(F.expr(solved("m", "b", "k")).alias("x"), F.expr(inverse("m", "k")).alias("i"), F.expr(cholesky("m", "k")).alias("l"), F.expr(positive("m", "k")).alias("p")).first()
        assert np.allclose(got["x"], np.linalg.solve(m, b)) and np.allclose(got["i"], np.linalg.inv(m)) and np.allclose(got["p"], m)
        assert np.allclose([r + [0.0] * (k - len(r)) for r in got["l"]], np.linalg.cholesky(m))
    flat = spark.createDataFrame([([[1.0, 1.0], [1.0, 1.0]], 2)], "m array<array<double>>, k int").select(F.expr(positive("m", "k")).alias("p")).first()["p"]
    assert np.linalg.eigvalsh(np.array(flat)).min() > 0 and np.allclose(flat, 1.0, atol=1e-5)


def test_points_are_least_squares_to_their_fixed_point(spark):
    cells = company(spark, 12)
    both = {lob: cells.where(F.col("lob") == lob).orderBy("origin_period", "dev_lag").collect() for lob in ("a", "b")}
    x = np.array([[r["value"] for r in v if r["dev_lag"] == 12][:12] for v in both.values()])
    y = np.array([[r["value"] for r in v if r["dev_lag"] == 24] for v in both.values()])
    for rounds in (1, 25):
        b, sigma, coef = fgls(x, y, rounds)
        got = sur.steps(cells, K, "lob", 12, rounds).first()
        assert got["method"] == "fgls" and got["n"] == 12
        assert np.allclose(got["beta"], b, rtol=1e-9) and np.allclose(got["sigma"], sigma, rtol=1e-8) and np.allclose(got["coef_cov"], coef, rtol=1e-8)


def test_thin_ages_pool_and_follow_the_tail_rule(spark):
    rows = []
    rng = np.random.default_rng(4)
    for i in range(7):
        c = rng.uniform(80, 120, 2)
        for j in range(7 - i):
            for l, lob in enumerate(("a", "b")):
                rows.append(("c", lob, date(2000 + i, 1, 1), 12 * (j + 1), float(c[l])))
            c = c * (1 + 0.5 / (j + 1) + rng.normal(0, 0.05, 2))
    found = {r["dev_lag"]: r for r in sur.steps(spark.createDataFrame(rows, SCHEMA), K, "lob", 12).collect()}
    assert [found[12 * j]["method"] for j in range(1, 7)] == ["fgls", "fgls", "fgls", "pooled_corr", "tail", "tail"]
    for p in range(2):
        v = [found[12 * j]["sigma"][p][p] for j in range(1, 7)]
        assert v[4] == pytest.approx(min(v[3] ** 2 / v[2], v[3], v[2])) and v[5] == pytest.approx(min(v[4] ** 2 / v[3], v[4], v[3]))
    pooled = found[48]["sigma"]
    corr = pooled[0][1] / np.sqrt(pooled[0][0] * pooled[1][1])
    tail = found[60]["sigma"]
    assert corr == pytest.approx(tail[0][1] / np.sqrt(tail[0][0] * tail[1][1])) and abs(corr) <= 1


def test_draws_have_the_covariance_of_process_and_slopes(spark):
    cells = company(spark, 30)
    step = sur.steps(cells, K, "lob", 12).first()
    n = 6000
    drawn = sur.draws(cells, K, "lob", 12, n_draws=n, seed=7)
    last = drawn.where("origin_period = '1980-01-01'").groupBy("draw").pivot("lob", ["a", "b"]).agg(F.first("ultimate")).orderBy("draw").toPandas()[["a", "b"]].to_numpy()
    c = np.array([r["value"] for r in cells.where("origin_period = '1980-01-01'").orderBy("lob").collect()])
    expected = np.sqrt(np.outer(c, c)) * np.array(step["sigma"]) + np.outer(c, c) * np.array(step["coef_cov"])
    assert np.allclose(last.mean(axis=0), c * np.array(step["beta"]), atol=4 * np.sqrt(np.diag(expected) / n).max())
    assert np.allclose(np.cov(last.T), expected, rtol=0.1)
    again = sur.draws(cells.repartition(7), K, "lob", 12, n_draws=50, seed=7).where("origin_period = '1980-01-01' and lob = 'a'").orderBy("draw").collect()
    assert np.allclose([r["ultimate"] for r in again], last[:50, 0])
    seen = drawn.where("origin_period = '1950-01-01' and draw = 3").collect()
    full = {r["lob"]: r["value"] for r in cells.where("origin_period = '1950-01-01' and dev_lag = 24").collect()}
    assert {r["lob"]: r["ultimate"] for r in seen} == full


def test_draws_of_the_catalogue_read_all_segments(spark, tmp_path):
    """All segments and origins, as the table has them: with a null segment, and one of two years only."""
    folder = "/root/testdata/sf0.001"
    few = "case when c_custkey % 10 = 0 then null when c_custkey % 10 = 1 then 'YOUNG' else c_mktsegment end"
    spark.read.parquet(f"{folder}/customer.parquet").withColumn("c_mktsegment", F.expr(few)).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_custkey % 10 != 1 or year(o_orderdate) >= 1997")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{folder}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    for d in (folder, str(tmp_path)):
        shown = {tuple(r) for r in marts.cells(spark, d).select("lob", "origin_period").distinct().collect()}
        found = catalogue.queries()["sur_draws"](spark, d).collect()
        assert len(found) == len(shown) and {(r["lob"], r["origin_period"]) for r in found} == shown
        assert {r["company"] for r in found} == {"all"} and all(r["mean"] > 0 for r in found)
    assert {None, "YOUNG", "BUILDING", "FURNITURE"} < {lob for lob, _ in shown}


def test_draws_of_lines_by_shape_are_those_of_their_own_company(spark):
    """Lines that show the same cells are drawn together; a line of fewer cells takes nothing from them."""
    cells = company(spark, 12)
    odd = cells.where("lob = 'a' and origin_period >= '1958-01-01'").withColumn("lob", F.lit(None).cast("string"))
    shaped = sur.alike(cells.unionByName(odd), K, "lob")
    assert shaped.count() == cells.count() + odd.count() and shaped.select("shape").distinct().count() == 2
    steps = sorted(sur.steps(shaped, [*K, "shape"], "lob", 12).collect(), key=lambda r: r["k"])
    alone = [sur.steps(c, K, "lob", 12).first() for c in (odd.fillna("c", ["lob"]), cells)]
    assert [r["k"] for r in steps] == [1, 2]
    for r, s in zip(steps, alone, strict=True):
        assert np.allclose(r["beta"], s["beta"]) and np.allclose(r["sigma"], s["sigma"]) and r["method"] == s["method"]


@pytest.mark.parametrize("factor", [0.0, -1.0])
def test_lines_without_amounts_leave_the_others_as_they_are(spark, factor):
    cells = company(spark, 12)
    odd = cells.where("lob = 'a'").withColumns({"lob": F.lit("odd"), "value": F.col("value") * factor})

    def drawn(rows):
        found = sur.draws(sur.alike(rows, K, "lob"), [*K, "shape"], "lob", 12, n_draws=20).collect()
        return {(r["lob"], r["origin_period"], r["draw"]): r["ultimate"] for r in found}

    alone, beside = drawn(cells), drawn(cells.unionByName(odd))
    assert len(beside) == len(alone) + 13 * 20 and alone.items() <= beside.items()
    assert all(v == v and v <= 0 for (lob, _, _), v in beside.items() if lob == "odd")
