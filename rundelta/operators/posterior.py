"""Posteriors of reserving models, sampled in numpy, one cohort a task; no probabilistic language is needed.

Priors and likelihoods are those of the published models; the samplers use what each model offers:

* ``ccl`` and ``csr`` (correlated chain ladder, changing settlement rate): for a given correlation or
  speed-up and given variances, log losses are a linear model with normal priors, so origin and age
  effects are drawn at once from their normal conditional; the one scalar is drawn by a slice of its density
  with the effects integrated out, and the variance increments (uniform on 0 to 1, added from the last age
  backwards) by slices.
* ``odp`` (over-dispersed Poisson): the posterior is log-concave; steps are proposed from its normal
  approximation at the mode, whole and as random walks.
* ``growth`` (hierarchical growth curve): loss ratios of origins are independent given the rest and move
  together; the five common parameters move one at a time, mean and spread of the loss ratios also with
  these held as they are, and curve and all loss ratios together along the covariance seen in the warm-up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import Refusal
from rundelta.functions.streams import cohort_stream, odp_draw
from rundelta.operators.fits import _by_cohort, growth, irls
from rundelta.operators.simulate import matrix

MODELS = ("ccl", "csr", "odp", "growth")
#: Prior standard deviation of level, origin and age effects.
WIDE = np.sqrt(10.0)


def slice_step(rng, log_density, x: float, low: float, high: float) -> float:
    """One slice-sampling step on a bounded interval, which shrinks towards the point it is at."""
    level = log_density(x) + np.log(rng.random())
    for _ in range(200):
        trial = rng.uniform(low, high)
        if log_density(trial) > level:
            return trial
        low, high = (trial, high) if trial < x else (low, trial)
    return x


def _linear_draws(rng, kind: str, log_cum: np.ndarray, log_premium: np.ndarray, n_draws: int, warm: int):
    """Log losses by origin and last age, drawn from the posterior of a linear model of logs."""
    n_w, n_d = log_cum.shape
    seen = ~np.isnan(log_cum)
    i, j = np.nonzero(seen)
    y = log_cum[seen] - log_premium[i]
    number = np.full(log_cum.shape, -1)
    number[seen] = np.arange(len(i))
    before = np.where(i > 0, number[np.maximum(i - 1, 0), j], -1)
    level = np.ones((len(i), 1))
    origin = (i[:, None] == np.arange(1, n_w)).astype(float)
    age = (j[:, None] == np.arange(n_d - 1)).astype(float)
    prior_mean = np.zeros(n_w + n_d - 1)
    prior_mean[0] = -0.4

    def residual_form(psi, a):
        """Innovations: the part of each row that the earlier origin's innovation leaves, origin after origin."""
        if kind == "csr":
            return a
        out = a.copy()
        for w in range(1, n_w):
            rows = np.flatnonzero((i == w) & (before >= 0))
            out[rows] -= psi * out[before[rows]]
        return out

    def design(psi):
        speed = (1 - psi) ** i if kind == "csr" else np.ones(len(i))
        return np.hstack([level, origin, age * speed[:, None]])

    def spread(u):
        return np.cumsum(u[::-1])[::-1]

    low, high = (-1.0, 1.0) if kind == "ccl" else (-0.5, 0.5)

    def prior(psi):
        return np.log1p(psi) + np.log1p(-psi) if kind == "ccl" else -0.5 * (psi / 0.05) ** 2

    def effects(p, v):
        """Precision's root and right side of the effects' normal conditional, and its mean."""
        x, z = residual_form(p, design(p)), residual_form(p, y)
        root = np.linalg.cholesky(x.T @ (x / v[:, None]) + np.eye(x.shape[1]) / WIDE**2)
        right = x.T @ (z / v) + prior_mean / WIDE**2
        return root, right, np.linalg.solve(root.T, np.linalg.solve(root, right)), float((z * z / v).sum())

    psi, u, out = 0.0, np.full(n_d, 0.05), np.zeros((n_draws, n_w))
    for step in range(-warm, n_draws):
        v = spread(u)[j]

        def without_effects(p, v=v):
            root, right, centre, squares = effects(p, v)
            return prior(p) - np.log(np.diag(root)).sum() + 0.5 * (right @ centre - squares)

        psi = slice_step(rng, without_effects, psi, low, high)
        root, _, centre, _ = effects(psi, v)
        theta = centre + np.linalg.solve(root.T, rng.normal(size=len(centre)))
        e2 = residual_form(psi, y - design(psi) @ theta) ** 2
        for k in range(n_d):

            def own(t, k=k, e2=e2):
                trial = u.copy()
                trial[k] = t
                w = spread(trial)[j]
                return -0.5 * float((np.log(w) + e2 / w).sum())

            u[k] = slice_step(rng, own, u[k], 1e-12, 1.0)
        if step >= 0:
            sd, last = np.sqrt(spread(u)[-1]), 0.0
            for w in range(n_w):
                mean = log_premium[w] + theta[0] + (theta[w] if w else 0.0)
                mean += psi * last if kind == "ccl" else 0.0
                value = log_cum[w, -1] if seen[w, -1] else mean + sd * rng.normal()
                last, out[step, w] = value - mean, value
    return np.exp(out)


def _odp_draws(rng, cum: np.ndarray, log_premium: np.ndarray, n_draws: int, warm: int):
    """Ultimates of the over-dispersed Poisson model with its dispersion held at the estimate."""
    inc = np.diff(np.concatenate([np.zeros((len(cum), 1)), cum], axis=1), axis=1)
    seen = ~np.isnan(inc)
    n_w, n_d = cum.shape
    i, j = np.nonzero(seen)
    y = inc[seen]
    if (y < 0).any():
        raise Refusal("negative_increment", "over-dispersed Poisson")

    def design(a, b):
        return np.hstack([np.ones((len(a), 1)), a[:, None] == np.arange(1, n_w), b[:, None] == np.arange(1, n_d)]).astype(float)

    x = design(i, j)
    _, mu = irls(x, y, 1.0)
    phi = float((((y - mu) ** 2) / mu).sum() / max(1, len(y) - x.shape[1]))
    if not phi > 0:
        raise Refusal("degenerate_fit", "no dispersion")

    def log_post(b):
        eta = log_premium[i] + x @ b
        return float((y * eta - np.exp(eta)).sum() / phi - 0.5 * (b * b).sum() / WIDE**2)

    b = np.linalg.lstsq(x, np.log(mu) - log_premium[i], rcond=None)[0]
    for _ in range(100):
        m = np.exp(log_premium[i] + x @ b)
        h = x.T @ (x * m[:, None]) / phi + np.eye(x.shape[1]) / WIDE**2
        step = np.linalg.solve(h, x.T @ (y - m) / phi - b / WIDE**2)
        b = b + step * min(1.0, 1.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-10:
            break
    mode, root = b, np.linalg.inv(np.linalg.cholesky(h)).T
    future = np.argwhere(~seen)
    xf, d = design(future[:, 0], future[:, 1]), len(b)
    now = np.array([r[~np.isnan(r)][-1] for r in cum])
    here, out = log_post(b), np.zeros((n_draws, n_w))

    def proposal(v):
        """Log density of a step drawn whole: a t distribution of eight degrees of freedom around the mode."""
        q = np.linalg.solve(root, v - mode)
        return -0.5 * (8 + d) * np.log1p((q @ q) / 8)

    for step in range(-warm, n_draws):
        for whole in (True, False, False):
            if whole:
                trial = mode + root @ rng.normal(size=d) / np.sqrt(rng.chisquare(8) / 8)
            else:
                trial = b + root @ rng.normal(size=d) * (1.7 / np.sqrt(d))
            there = log_post(trial)
            gain = there - here + (proposal(b) - proposal(trial) if whole else 0.0)
            if np.log(rng.random()) < gain:
                b, here = trial, there
        if step >= 0:
            draws = odp_draw(rng, np.exp(log_premium[future[:, 0]] + xf @ b), phi)
            out[step] = now + np.bincount(future[:, 0], weights=draws, minlength=n_w)
    return out


def _growth_draws(rng, cum: np.ndarray, premium: np.ndarray, years: np.ndarray, curve: str, n_draws: int, warm: int):
    """Ultimates (at the last age) of the hierarchical growth curve of cumulative loss ratios."""
    n_w = len(cum)
    seen = ~np.isnan(cum)
    i, j = np.nonzero(seen)
    ratio = cum / premium[:, None]
    y, t = np.log(ratio[seen]), years[j]
    pull = np.log1p  # of squares over three: minus two log densities over four of a t distribution

    def log_prior(p):
        pop, omega, theta, sd, sigma = p
        if min(p) <= 0:
            return -np.inf
        a = -0.5 * (np.log(pop / 0.6) / np.log(2)) ** 2 - np.log(pop) - 0.5 * (omega - 2) ** 2 - 0.5 * (theta - 4) ** 2
        return a - 2 * pull(sd * sd / 3) - 2 * pull(sigma * sigma / 3)

    def fitted(ulr, omega, theta):
        return np.log(ulr[i] * np.maximum(growth(t, omega, theta, curve), 1e-300))

    def log_lik(z, p):
        ulr = p[0] + p[3] * z
        if (ulr <= 0).any():
            return np.full(n_w, -np.inf)
        e = (y - fitted(ulr, p[1], p[2])) / p[4]
        return np.bincount(i, weights=-0.5 * e * e - np.log(p[4]), minlength=n_w)

    p, z = np.array([0.6, 2.0, 4.0, 0.2, 0.2]), np.zeros(n_w)
    size, width = np.array([0.1, 0.1, 0.1, 0.3, 0.2]), np.full(n_w, 0.5)
    lik, out = log_lik(z, p), np.zeros((n_draws, n_w))
    history, joint = [], None

    def accepted(gain):
        return np.log(rng.random()) < gain

    for step in range(-warm, n_draws):
        for _ in range(3):
            trial = z + width * rng.normal(size=n_w)
            positive = p[0] + p[3] * trial > 0
            per = np.where(positive, log_lik(np.where(positive, trial, z), p), -np.inf)
            yes = np.log(rng.random(n_w)) < per - lik - 0.5 * (trial**2 - z**2)
            z, lik = np.where(yes, trial, z), np.where(yes, per, lik)
            if step < 0:
                width = width * np.where(yes, 1.05, 0.96)
            for k in range(5):
                q = p.copy()
                q[k] *= np.exp(size[k] * rng.normal())
                new = log_lik(z, q)
                yes = accepted(new.sum() - lik.sum() + log_prior(q) - log_prior(p) + np.log(q[k] / p[k]))
                if yes:
                    p, lik = q, new
                if step < 0:
                    size[k] *= 1.05 if yes else 0.97
            for _ in range(0 if joint is None else 4):
                # Omega, theta and the loss ratios of all origins.
                a = joint @ rng.normal(size=3) * 1.4
                q = p * np.exp([0, a[0], a[1], 0, 0])
                other = ((p[0] + p[3] * z) * np.exp(a[2]) - p[0]) / p[3]
                new = log_lik(other, q)
                if accepted(new.sum() - lik.sum() + log_prior(q) - log_prior(p) - 0.5 * float((other**2 - z**2).sum()) + a[0] + a[1] + n_w * a[2]):
                    p, z, lik = q, other, new
            for k in (0, 3):
                # The loss ratios stay, their mean or spread moves.
                q, ulr = p.copy(), p[0] + p[3] * z
                q[k] *= np.exp(0.3 * rng.normal())
                other = (ulr - q[0]) / q[3]
                gain = log_prior(q) - log_prior(p) - 0.5 * float((other**2 - z**2).sum()) - n_w * np.log(q[3] / p[3]) + np.log(q[k] / p[k])
                if accepted(gain):
                    p, z = q, other
        if step < 0:
            history.append(np.log([p[1], p[2], (p[0] + p[3] * z).mean()]))
            if len(history) in (warm // 4, warm // 2, 3 * warm // 4) and len(history) > 20:
                joint = np.linalg.cholesky(np.cov(np.array(history[len(history) // 3 :]).T) + 1e-9 * np.eye(3))
        if step >= 0:
            ulr = p[0] + p[3] * z
            at_end = np.log(np.maximum(ulr, 1e-300) * growth(years[-1], p[1], p[2], curve))
            out[step] = np.where(seen[:, -1], np.nan_to_num(cum[:, -1]), premium * np.exp(at_end + p[4] * rng.normal(size=n_w)))
    return out


def posterior(cells: DataFrame, premium: DataFrame, keys: list[str], model: str, n_draws: int = 1000, warm: int = 1000, seed: int = 1, curve: str = "loglogistic") -> DataFrame:
    """keys, origin_period, draw, value, error: ultimates at the last age from a model's posterior.

    Ages of ``growth`` are years.  Cohorts that a model cannot take (losses of zero or less in logs, negative
    increments of ``odp``) are one row with the reason.  Draws follow the seed and the cohort alone.
    """
    if model not in MODELS:
        raise Refusal("invalid_option", f"model {model!r}")
    joined = cells.join(premium, [*keys, "origin_period"]).select(*keys, "origin_period", "dev_lag", "value", "premium")

    def fit(key, pdf):
        rng = cohort_stream(seed, model, key)
        origins, lags, cum = matrix(pdf)
        p = pdf.groupby("origin_period")["premium"].first().loc[origins].to_numpy(dtype=float)
        if model != "odp" and (cum[~np.isnan(cum)] <= 0).any():
            raise Refusal("not_supported", "losses of zero or less have no logarithm")
        if model == "odp":
            out = _odp_draws(rng, cum, np.log(p), n_draws, warm)
        elif model == "growth":
            out = _growth_draws(rng, cum, p, np.array(lags) / 12, curve, n_draws, warm)
        else:
            out = _linear_draws(rng, model, np.log(cum), np.log(p), n_draws, warm)
        return pd.DataFrame({"origin_period": np.repeat(np.array(origins), n_draws), "draw": np.tile(np.arange(n_draws), len(origins)), "value": out.T.ravel()})

    return _by_cohort(joined, keys, fit, "origin_period date, draw bigint, value double")


def compare_posteriors(a: DataFrame, b: DataFrame, keys: list[str], n_chunks: int = 20, limit: float = 4.0, value: str = "value") -> DataFrame:
    """keys, mean and sd of both, z_mean, z_sd, agree: differences in units of their Monte Carlo errors.

    A chain's effective size comes from the variance of the means of ``n_chunks`` consecutive chunks; the
    error of a standard deviation from the fourth moment, so heavy tails are allowed for.
    """

    def described(draws, name):
        cohort = Window.partitionBy(*keys)
        rows = draws.withColumns({"chunk": F.ntile(n_chunks).over(cohort.orderBy("draw")), "middle": F.avg(value).over(cohort)}).withColumn("c", F.col(value) - F.col("middle"))
        parts = rows.groupBy(*keys, "middle", "chunk").agg(F.avg(value).alias("m"), F.sum(F.pow("c", F.lit(2))).alias("s2"), F.sum(F.pow("c", F.lit(4))).alias("s4"), F.count(F.lit(1)).alias("n"))
        out = parts.groupBy(*keys).agg(F.first("middle").alias("mean"), F.sum("s2").alias("s2"), F.sum("s4").alias("s4"), F.sum("n").alias("n"), F.var_samp("m").alias("between"))
        var = F.col("s2") / (F.col("n") - 1)
        ess = F.least(F.col("n").cast("double"), F.try_divide(n_chunks * var, F.col("between")))
        # Squared errors of the mean and of the standard deviation.
        spread = (F.col("s4") / F.col("n") - F.pow(F.col("s2") / F.col("n"), F.lit(2))) / (4 * var * ess)
        return out.select(*keys, F.col("mean").alias(f"{name}_mean"), F.sqrt(var).alias(f"{name}_sd"), ess.alias(f"{name}_ess"), (var / ess).alias(f"{name}_e1"), spread.alias(f"{name}_e2"))

    met = described(a, "a").join(described(b, "b"), keys)
    z_mean = (F.col("a_mean") - F.col("b_mean")) / F.sqrt(F.col("a_e1") + F.col("b_e1"))
    z_sd = (F.col("a_sd") - F.col("b_sd")) / F.sqrt(F.col("a_e2") + F.col("b_e2"))
    out = met.withColumns({"z_mean": z_mean, "z_sd": z_sd}).drop("a_e1", "a_e2", "b_e1", "b_e2")
    return out.withColumn("agree", (F.abs("z_mean") <= limit) & (F.abs("z_sd") <= limit))
