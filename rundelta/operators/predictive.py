"""Predictive distributions as long tables of draws, their scores, panels of models, stacking, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.functions.ranks import medians, ranked, with_ntile
from rundelta.functions.storage import kept


def summary(draws: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, standard deviation (n - 1), coefficient of variation and quartiles."""
    v = F.col(value)
    out = draws.groupBy(*keys).agg(F.count(v).alias("n_draws"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), *[F.percentile(v, p).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return out.withColumn("cv", F.try_divide("sd", "mean"))


def quantile_tvar(draws: DataFrame, keys: list[str], level: float, value: str = "value") -> DataFrame:
    """The linear (type 7) quantile and the mean of the draws at or above it."""
    q = draws.groupBy(*keys).agg(F.percentile(value, level).alias("quantile"))
    return draws.join(q, keys).where(F.col(value) >= F.col("quantile")).groupBy(*keys, "quantile").agg(F.avg(value).alias("tvar"))


def with_total(draws: DataFrame, keys: list[str], draw: str = "draw", value: str = "value") -> DataFrame:
    """Draws of every key and, with null keys, of their sum in the same draw."""
    total = draws.groupBy(draw).agg(F.sum(value).alias(value))
    return draws.select(*keys, draw, value).unionByName(total, allowMissingColumns=True)


def pit(draws: DataFrame, observed: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Share of draws at or below the observation; null where either is missing."""
    joined = draws.join(observed.select(*keys, "observed"), keys)
    missing = F.count_if(F.col(value).isNull() | F.col("observed").isNull()) > 0
    return joined.groupBy(*keys).agg(F.when(~missing, F.avg((F.col(value) <= F.col("observed")).cast("double"))).alias("pit"))


def crps(draws: DataFrame, observed: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean absolute error less half the mean distance of two draws, from the ranks of the draws."""
    joined = draws.join(observed.select(*keys, "observed"), keys)
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = joined.withColumns({"i": i, "n": n})
    return ranked.groupBy(*keys).agg((F.avg(F.abs(F.col(value) - F.col("observed"))) - F.sum((2 * F.col("i") - F.col("n") - 1) * F.col(value)) / F.max(F.col("n") * F.col("n"))).alias("crps"))


def pp_points(pits: DataFrame, keys: list[str], column: str = "pit") -> DataFrame:
    """Sorted values against the uniform's expected ones."""
    w = Window.partitionBy(*keys)
    return pits.where(F.col(column).isNotNull()).withColumns({"i": F.row_number().over(w.orderBy(column)), "n": F.count(F.lit(1)).over(w)}).select(*keys, "i", F.col(column).alias("observed_p"), (F.col("i") / (F.col("n") + 1)).alias("expected_p"), "n")


def ks_uniformity(pits: DataFrame, keys: list[str], column: str = "pit") -> DataFrame:
    """Distance to the uniform, its asymptotic p-value (100 terms) and the 5% critical value."""
    i, n, p = F.col("i"), F.col("n"), F.col("observed_p")
    out = pp_points(pits, keys, column).groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.greatest(i / n - p, p - (i - 1) / n)).alias("d"))
    p_value = F.expr("aggregate(sequence(1, 100), 0D, (a, k) -> a + 2 * if(k % 2 = 1, 1, -1) * exp(-2D * k * k * n * d * d))")
    return out.withColumns({"p_value": F.greatest(F.lit(0.0), F.least(F.lit(1.0), p_value)), "critical_5pct": 1.36 / F.sqrt("n")}).withColumn("reject_5pct", F.col("d") > F.col("critical_5pct"))


def log_mean_exp(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Log of the mean of exponentials, by the group's largest value; minus infinity if all are."""
    top = df.groupBy(*keys).agg(F.max(column).alias("top"))
    low = F.lit(float("-inf"))
    mean = F.avg(F.when(F.col("top") == low, F.lit(0.0)).otherwise(F.exp(F.col(column) - F.col("top"))))
    return df.join(top, keys).groupBy(*keys, "top").agg(mean.alias("mean")).select(*keys, F.when(F.col("top") == low, low).otherwise(F.col("top") + F.ln("mean")).alias("log_mean_exp"))


def kish_ess(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.pow(F.sum(weight), F.lit(2)) / F.sum(F.col(weight) * F.col(weight))).alias("ess"))


# --- densities ----------------------------------------------------------------------------------

_LOG_2PI = float(np.log(2 * np.pi))


def normal_lpdf(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return -0.5 * z * z - F.ln(sigma) - 0.5 * _LOG_2PI


def lognormal_lpdf(y: Column, mu: Column, sigma: Column) -> Column:
    return F.when(y > 0, normal_lpdf(F.ln(y), mu, sigma) - F.ln(y)).otherwise(F.lit(float("-inf")))


def to_amount_scale(log_density: Column, measure: str, value: Column | None = None, premium: Column | None = None) -> Column:
    """A log density with respect to amounts, from one on another scale."""
    if measure == "amount":
        return log_density
    if measure == "log_amount":
        return log_density - F.ln(value)
    if measure == "loss_ratio":
        return log_density - F.ln(premium)
    raise ValueError(measure)


# --- panels -------------------------------------------------------------------------------------


def align_panel(scores: DataFrame, cell: list[str], score: str = "elpd") -> DataFrame:
    """Rows of the cells that every model has a score for (counted with the models, so none is favoured)."""
    have = scores.where(F.col(score).isNotNull())
    models = have.agg(F.count_distinct("model").alias("models"))
    common = have.groupBy(*cell).agg(F.count_distinct("model").alias("m")).crossJoin(F.broadcast(models)).where("m = models").select(*cell)
    return have.join(common, cell, "left_semi")


def leaderboard(scores: DataFrame, cell: list[str], density: str = "elpd", distance: str = "crps") -> DataFrame:
    """model, elpd over its panel, mean crps over its own, cells in each; models in name order, no ranking.

    The two panels are separate intersections; a model without a kind of score has null, never 0.
    """
    parts = []
    for column, agg, name in ((density, F.sum, "elpd"), (distance, F.avg, "crps")):
        panel = align_panel(scores, cell, column)
        parts.append(panel.groupBy("model").agg(agg(column).alias(name), F.count(F.lit(1)).alias(f"n_{name}")))
    names = scores.select("model").distinct()
    return names.join(parts[0], "model", "left").join(parts[1], "model", "left").orderBy("model")


def stacking_weights(panel: DataFrame, cell: list[str], score: str = "elpd", floor: float = -700.0, rounds: int = 100, tolerance: float = 1e-10) -> dict[str, float]:
    """Weights of the mixture with the highest mean log score, by Newton's method on the simplex.

    A step needs the gradient and the curvature, which are sums over cells: two aggregates a step, with a
    number for each pair of models; no cell reaches the driver.  At the optimum the gradient is 1 where a
    weight is positive and at most 1 elsewhere, which is what ends the search.
    """
    best = F.max(score).over(Window.partitionBy(*cell))
    rel = panel.withColumn("rel", F.greatest(F.col(score) - best, F.lit(floor)))
    models = sorted(r[0] for r in panel.select("model").distinct().collect())
    k = len(models)
    if k < 2:
        return dict.fromkeys(models, 1.0)
    wide = rel.groupBy(*cell).pivot("model", models).agg(F.first("rel"))
    wide = kept(wide.select(*[F.exp(F.col(f"`{m}`")).alias(f"p{i}") for i, m in enumerate(models)]), "stacking")

    def mixed(w):
        return sum((F.col(f"p{i}") * float(w[i]) for i in range(k)), F.lit(0.0))

    w, free = np.full(k, 1 / k), np.ones(k, dtype=bool)
    for _ in range(rounds):
        share = [F.col(f"p{i}") / mixed(w) for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        r = wide.agg(*[F.avg(x) for x in share], *[F.avg(share[i] * share[j]) for i, j in pairs]).first()
        if r[0] is None:
            return dict(zip(models, w.tolist(), strict=True))
        g, m = np.array(r[:k]), np.zeros((k, k))
        for (i, j), x in zip(pairs, r[k:], strict=True):
            m[i, j] = m[j, i] = x
        outside = np.where(free, -np.inf, g)
        if outside.max() > 1 + tolerance and np.abs(g[free] - 1).max() < 1e-6:
            free[outside.argmax()] = True
        elif np.abs(g[free] - 1).max() < tolerance:
            break
        at = np.flatnonzero(free)
        system = np.ones((len(at) + 1, len(at) + 1))
        system[:-1, :-1], system[-1, -1] = m[np.ix_(at, at)] + 1e-12 * np.eye(len(at)), 0
        d = np.zeros(k)
        d[at] = np.linalg.lstsq(system, np.append(g[at], 0), rcond=None)[0][:-1]
        down = np.flatnonzero(d < 0)
        limit = min(1.0, float((-w[down] / d[down]).min())) if len(down) else 1.0
        steps = [limit * 0.5**n for n in range(8)]
        gains = wide.agg(*[F.avg(F.ln(mixed(np.maximum(w + a * d, 0))) - F.ln(mixed(w))) for a in steps]).first()
        a = steps[int(np.argmax([-np.inf if x is None or not np.isfinite(x) else x for x in gains]))]
        new = np.maximum(w + a * d, 0)
        new[new < 1e-14] = 0
        free = new > 0
        moved, w = np.abs(new / new.sum() - w).max(), new / new.sum()
        if moved < 1e-15:
            break
    return dict(zip(models, w.tolist(), strict=True))


def pseudo_bma_weights(panel: DataFrame, score: str = "elpd") -> DataFrame:
    """Weights in proportion to the exponential of total scores."""
    total = panel.groupBy("model").agg(F.sum(score).alias("total"))
    e = F.exp(F.col("total") - F.max("total").over(Window.partitionBy()))
    return total.withColumn("weight", e / F.sum(e).over(Window.partitionBy()))


# --- calibration --------------------------------------------------------------------------------


def residual_strata(rows: DataFrame, n_strata: int, predicted: str = "predicted", actual: str = "actual", size: str = "size", floor: float = 0.01) -> DataFrame:
    """Residuals over the larger of prediction, ``floor`` of size and 1, with their size stratum (larger bins first)."""
    scale = F.greatest(F.abs(predicted), floor * F.col(size), F.lit(1.0))
    return with_ntile(rows.withColumn("residual", (F.col(actual) - F.col(predicted)) / scale), [size, actual], n_strata, "stratum")


def calibration_pools(residuals: DataFrame, keys: list[str], least: int = 40) -> DataFrame:
    """Residuals centred on their pool's median; pools below ``least`` fall back to all residuals."""
    pools = medians(residuals, keys, "residual", "own").withColumnsRenamed({k: f"pool_{k}" for k in keys} | {"n": "pool_n"})
    everyone = medians(residuals, [], "residual", "everyone").select("everyone")
    same = [F.col(k).eqNullSafe(F.col(f"pool_{k}")) for k in keys]
    out = residuals.join(pools, same, "left").drop(*[f"pool_{k}" for k in keys]).crossJoin(F.broadcast(everyone))
    pooled = F.coalesce("pool_n", F.lit(0)) >= least
    return out.withColumns({"pooled": pooled, "centred": F.col("residual") - F.when(pooled, F.col("own")).otherwise(F.col("everyone"))}).drop("own", "everyone")


def calibrated_draws(points: DataFrame, residuals: DataFrame, keys: list[str], n_draws: int, seed: int = 1, pool: str = "stratum", point: str = "predicted", size: str = "size", floor: float = 0.01) -> DataFrame:
    """``points`` with draw and value: the point plus its scale times a resampled centred residual of its pool.

    ``residuals`` has the pool and ``centred``.  A pool's rows are numbered; a draw's number is a hash of the
    seed, the point's keys and the draw, so draws are the same on any partitioning and no Python runs.
    """
    placed = ranked(residuals.select(pool, "centred"), [pool, "centred"], "_rank")
    sizes = placed.groupBy(pool).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    numbered = placed.join(sizes, pool).select(F.col(pool).alias("_pool"), (F.col("_rank") - F.col("_first")).alias("_at"), "centred")
    scale = F.greatest(F.abs(point), floor * F.col(size), F.lit(1.0))
    drawn = points.join(sizes, pool).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    drawn = drawn.withColumn("_pick", F.pmod(F.xxhash64(F.lit(seed), *keys, "draw"), F.col("_n")))
    out = drawn.join(numbered, (F.col(pool) == F.col("_pool")) & (F.col("_pick") == F.col("_at")))
    return out.withColumn("value", F.col(point) + scale * F.col("centred")).select(*points.columns, "draw", "value")


def apply_weights(draws: DataFrame, weights: DataFrame, keys: list[str], n_draws: int) -> DataFrame:
    """keys, draw, model, value: a mixture's draws, each model giving its share of them.

    ``draws`` has model, keys, draw (from 0, at least ``n_draws`` of each) and value.  Shares are whole
    numbers by largest remainders, ties to the first model by name; a model gives its first draws.
    """
    exact = F.col("weight") / F.sum("weight").over(Window.partitionBy()) * n_draws
    shares = weights.where("weight > 0").withColumns({"exact": exact}).withColumn("low", F.floor("exact").cast("int"))
    left = F.lit(n_draws) - F.sum("low").over(Window.partitionBy())
    turn = F.row_number().over(Window.orderBy((F.col("exact") - F.col("low")).desc(), "model"))
    shares = shares.withColumn("n", F.col("low") + (turn <= left).cast("int")).withColumn("from", F.sum("n").over(Window.orderBy("model")) - F.col("n"))
    met = draws.join(F.broadcast(shares.select("model", "n", "from")), "model").where("draw < n")
    return met.select(*keys, (F.col("draw") + F.col("from")).alias("draw"), "model", "value")


def quantile_type8(df: DataFrame, keys: list[str], column: str, p: float) -> DataFrame:
    """keys, n, quantile: the median-unbiased quantile, at place (n + 1/3) p + 1/3 of a group's sorted values."""
    placed = ranked(df.where(F.col(column).isNotNull()).select(*keys, column), [*keys, column], "_rank")
    sizes = placed.groupBy(*keys).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    place = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), (F.col("n") + 1 / 3) * p + 1 / 3))
    rows = placed.join(sizes.withColumn("_at", place), keys).withColumn("_i", F.col("_rank") - F.col("_first") + 1)
    low, part = F.floor("_at"), F.col("_at") - F.floor("_at")
    near = rows.where((F.col("_i") == low) | (F.col("_i") == low + 1))
    return near.groupBy(*keys, "n").agg(F.sum(F.when(F.col("_i") == low, (1 - part) * F.col(column)).otherwise(part * F.col(column))).alias("quantile"))
