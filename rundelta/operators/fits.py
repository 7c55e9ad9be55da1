"""Iterative fits, one cohort (or company) per group: Tweedie GLM, growth curves, multivariate chain ladder, copula."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import Refusal
from rundelta.functions.streams import cohort_stream, nelder_mead, odp_lpdf
from rundelta.operators.simulate import key_schema, matrix


def _by_cohort(cells: DataFrame, keys: list[str], fit, extra: str, columns: list[str] | None = None) -> DataFrame:
    """Run ``fit(key, frame) -> frame`` per cohort; a cohort that fails becomes one row with its error."""
    schema = key_schema(cells, keys) + extra + ", error string"
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(key, pdf):
        try:
            out = fit(key, pdf)
            out["error"] = None
        except (Refusal, ArithmeticError, np.linalg.LinAlgError) as e:  # a cohort's failure is a row; a fault of the code is not
            out = pd.DataFrame([[None] * len(names)], columns=names, dtype=object)
            out["error"] = f"{type(e).__name__}: {e}"
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out.reindex(columns=names)

    return cells.groupBy(*keys).applyInPandas(run, schema)


#: A fitted mean below this share of the largest increment, on an increment of zero or less, is a fit in the limit only.
BOUNDARY = 1e-10


def irls(x: np.ndarray, y: np.ndarray, power: float, link: str = "log", rounds: int = 200, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and means of a Tweedie model by weighted least squares with step halving.

    Steps are halved until means are valid and, with a log link, until the quasi-likelihood does not
    fall.  That is defined for negative amounts too (the score equations are those of the means), and at
    power 1 it is concave, so its one maximum is found.
    """
    log, size = link == "log", float(np.abs(y).max())
    y = y / size
    mu = (np.where(y > 0, y, y[y > 0].mean() if (y > 0).any() else 1.0) + max(y.mean(), 1e-3)) / 2
    eta, beta, last = np.log(mu) if log else mu, None, np.inf

    def loss(m):
        if power == 0:
            return float(((y - m) ** 2).sum())
        if power == 1:
            return float((m - y * np.log(m)).sum())
        if power == 2:
            return float((y / m + np.log(m)).sum())
        return float((m ** (2 - power) / (2 - power) - y * m ** (1 - power) / (1 - power)).sum())

    def good(m):
        if not np.isfinite(m).all() or ((log or power > 0) and (m <= 0).any()):
            return False
        return not log or loss(m) <= last + 1e-9 * abs(last) + 1e-12

    for _ in range(rounds):
        w = mu ** (2 - power) if log else 1 / np.abs(mu) ** power
        z = eta + (y - mu) / mu if log else y
        root = np.sqrt(w)
        new, _, rank, _ = np.linalg.lstsq(x * root[:, None], z * root, rcond=1e-13)
        if rank < x.shape[1]:
            raise Refusal("degenerate_fit", "the weighted design lost rank")
        for _ in range(50):
            trial = np.exp(np.clip(x @ new, -700, 700)) if log else x @ new
            if good(trial) or beta is None:
                break
            new = (new + beta) / 2
        if not log and power > 0 and (trial <= 0).any():
            raise Refusal("negative_fitted_mean", "the identity link gives a mean of zero or less", "link")
        moved = np.abs(trial - mu).max()
        beta, mu = new, trial
        last = loss(mu) if log else last
        eta = x @ beta
        if moved <= tolerance:
            if (log or power > 0) and ((mu < BOUNDARY) & (y <= 0)).any():
                raise Refusal("degenerate_fit", "a mean falls to zero: the fit exists in the limit only")
            return beta, mu * size
    raise Refusal("did_not_converge", f"{rounds} steps")


@dataclass(frozen=True)
class Tweedie:
    """What ``tweedie_glm`` fits.

    ``power`` is 0 or at least 1; ``link`` log or identity; ``origin`` factor or none; ``calendar`` none or
    trend (without origin factors only, as it is a sum of both kinds of factors); ``projection`` pattern
    (latest times the fitted development) or increments (latest plus fitted increments; with origin
    factors only).  ``negative`` says what a negative increment does at powers below 2: ``quasi`` keeps it
    as data of the score equations, ``refuse`` turns the cohort down, as densities do not allow it.
    """

    power: float = 1.0
    link: str = "log"
    origin: str = "factor"
    calendar: str = "none"
    projection: str = "pattern"
    negative: str = "quasi"

    def __post_init__(self):
        ok = (self.power == 0 or self.power >= 1) and self.link in ("log", "identity") and self.origin in ("factor", "none") and self.calendar in ("none", "trend") and self.projection in ("pattern", "increments") and self.negative in ("quasi", "refuse")
        ok &= self.origin == "none" or self.calendar == "none"
        ok &= self.origin == "factor" or self.projection == "pattern"
        if not ok:
            raise Refusal("invalid_option", str(self))

    def design(self, i: np.ndarray, j: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Columns for cells (i, j): intercept or origins, ages but the first, trend."""
        parts = [i[:, None] == rows[None, :]] if self.origin == "factor" else [np.ones((len(i), 1))]
        parts.append(j[:, None] == columns[None, 1:])
        if self.calendar == "trend":
            parts.append((i + j)[:, None])
        return np.hstack([p.astype(float) for p in parts])

    def fit(self, cum: np.ndarray) -> tuple[np.ndarray, float]:
        """Fitted increments of the whole rectangle and the dispersion."""
        inc = np.diff(np.concatenate([np.zeros((len(cum), 1)), cum], axis=1), axis=1)
        seen = ~np.isnan(inc)
        if not (seen & (inc != 0)).any():
            raise Refusal("not_identified", "every increment is zero")
        if (seen & (inc < 0)).any() and (self.power >= 2 or self.power >= 1 and self.negative == "refuse"):
            raise Refusal("negative_increment", f"power {self.power:g}")
        if (seen & (inc == 0)).any() and self.power >= 2:
            raise Refusal("zero_increment", f"power {self.power:g}")
        # With a log link, what holds no losses at all is fitted by zero outside the regression.
        losses = seen & (inc != 0)
        log = self.link == "log"
        rows = np.flatnonzero(losses.any(axis=1)) if log and self.origin == "factor" else np.arange(len(cum))
        columns = np.flatnonzero(losses.any(axis=0)) if log else np.arange(cum.shape[1])
        live = np.zeros(cum.shape, dtype=bool)
        live[np.ix_(rows, columns)] = True
        i, j = np.nonzero(seen & live)
        x = self.design(i, j, rows, columns)
        if np.linalg.matrix_rank(x) < x.shape[1]:
            raise Refusal("not_identified", "the cells cannot tell the terms apart")
        beta, mu = irls(x, inc[i, j], self.power, self.link)
        a, b = np.nonzero(live)
        eta = self.design(a, b, rows, columns) @ beta
        fitted = np.zeros(cum.shape)
        fitted[a, b] = (np.exp(eta) if log else eta) * float(np.abs(inc[i, j]).max())
        if not log and self.power > 0 and (fitted <= 0).any():
            raise Refusal("negative_fitted_mean", "the identity link gives a mean of zero or less", "link")
        dof = len(i) - x.shape[1]
        squares = float((((inc[i, j] - mu) ** 2) / np.abs(mu) ** self.power).sum())
        return fitted, squares / dof if dof > 0 else np.nan


def tweedie_glm(cells: DataFrame, keys: list[str], power: float = 1.0, **options) -> DataFrame:
    """keys, origin_period, latest, ultimate, ibnr, phi, error: a Tweedie model of increments (see ``Tweedie``).

    At power 1 with a log link the ultimates are those of the chain ladder.  A cohort that is turned
    down is one row with its reason.
    """
    model = Tweedie(power, **options)

    def fit(key, pdf):
        origins, _, cum = matrix(pdf)
        fitted, phi = model.fit(cum)
        last = np.array([np.flatnonzero(~np.isnan(r)).max() for r in cum])
        now = cum[np.arange(len(cum)), last]
        if model.projection == "increments":
            ultimate = now + np.where(np.isnan(cum), fitted, 0).sum(axis=1)
        else:
            run = np.cumsum(fitted, axis=1)
            at = run[np.arange(len(cum)), last]
            ultimate = now * np.where(at != 0, run[:, -1] / np.where(at != 0, at, 1), 1.0)
        if ((ultimate < 0) & (np.nanmin(cum, axis=1) >= 0)).any():
            raise Refusal("negative_projection", "an ultimate below zero")
        return pd.DataFrame({"origin_period": origins, "latest": now, "ultimate": ultimate, "ibnr": ultimate - now, "phi": phi})

    return _by_cohort(cells.select(*keys, "origin_period", "dev_lag", "value"), keys, fit, "origin_period date, latest double, ultimate double, ibnr double, phi double")


def growth(x, omega: float, theta: float, curve: str):
    """Share developed at a mid-period age."""
    x = np.maximum(x, 0)
    return x**omega / (x**omega + theta**omega) if curve == "loglogistic" else 1 - np.exp(-((x / theta) ** omega))


def clark(cells: DataFrame, premium: DataFrame, keys: list[str], curve: str = "loglogistic", method: str = "cape_cod") -> DataFrame:
    """keys, origin_period, latest, ultimate, ibnr, omega, theta, phi: growth curves by Poisson likelihood.

    Ages count from mid-period; ``ldf`` has an ultimate per origin (paid over developed share),
    ``cape_cod`` one loss ratio for all.
    """
    joined = cells.join(premium, [*keys, "origin_period"]).select(*keys, "origin_period", "dev_lag", "value", "premium")

    def fit(key, pdf):
        origins, lags, cum = matrix(pdf)
        p = pdf.groupby("origin_period")["premium"].first().loc[origins].to_numpy(dtype=float)
        inc = np.diff(np.concatenate([np.zeros((len(cum), 1)), cum], axis=1), axis=1)
        age = np.array(lags, dtype=float)
        i, j = np.nonzero(~np.isnan(inc))
        now = np.array([r[~np.isnan(r)][-1] for r in cum])
        at = np.array([age[np.flatnonzero(~np.isnan(r)).max()] for r in cum]) - 6

        def means(omega, theta):
            g = growth(np.maximum(age - 6, 0), omega, theta, curve)
            share = np.diff(np.concatenate([[0], g]))
            reached = growth(at, omega, theta, curve)
            total = now / reached if method == "ldf" else p * now.sum() / (p * reached).sum()
            return total, total[i] * share[j]

        def loss(v):
            _, mu = means(*np.exp(v))
            if not np.isfinite(mu).all() or (mu <= 0).any():
                return 1e300
            return float((mu - inc[i, j] * np.log(mu)).sum())

        best, value = nelder_mead(loss, [np.log(1.2), np.log(18.0)])
        if value >= 1e300:
            raise ArithmeticError("did_not_converge")
        omega, theta = np.exp(best)
        total, mu = means(omega, theta)
        k = (len(origins) if method == "ldf" else 1) + 2
        phi = float((((inc[i, j] - mu) ** 2) / mu).sum() / max(1, len(i) - k))
        ult = total if method == "ldf" else now + total * (1 - growth(at, omega, theta, curve))
        return pd.DataFrame({"origin_period": origins, "latest": now, "ultimate": ult, "ibnr": ult - now, "omega": omega, "theta": theta, "phi": phi})

    return _by_cohort(joined, keys, fit, "origin_period date, latest double, ultimate double, ibnr double, omega double, theta double, phi double")


def _lines(pdf: pd.DataFrame, line: str) -> tuple[list, list, list, np.ndarray]:
    lines = sorted(pdf[line].unique())
    origins, lags = sorted(pdf["origin_period"].unique()), sorted(int(x) for x in pdf["dev_lag"].unique())
    cube = np.full((len(lines), len(origins), len(lags)), np.nan)
    where = [{v: n for n, v in enumerate(x)} for x in (lines, origins, lags)]
    for a, o, d, v in zip(pdf[line], pdf["origin_period"], pdf["dev_lag"], pdf["value"], strict=True):
        cube[where[0][a], where[1][o], where[2][int(d)]] = v
    return lines, origins, lags, cube


def _system(x: np.ndarray, y: np.ndarray, full: bool) -> np.ndarray:
    """Development matrix of several lines (rows: target line): feasible generalised least squares.

    Errors scale with the root of the own line's volume; without enough pairs each line stands alone
    on its volume factor.
    """
    k, n = x.shape
    diagonal = np.diag(y.sum(axis=1) / x.sum(axis=1))
    if n <= (2 * k if full else k):
        return diagonal
    scale = np.sqrt(np.maximum(x, 1e-9))
    blocks = [(x / scale[a]).T if full else (x[a] / scale[a])[:, None] for a in range(k)]
    target = [y[a] / scale[a] for a in range(k)]
    ols = [np.linalg.lstsq(b, t, rcond=None)[0] for b, t in zip(blocks, target, strict=True)]
    r = np.array([t - b @ c for b, t, c in zip(blocks, target, ols, strict=True)])
    cov = r @ r.T / max(1, n - (k if full else 1)) + 1e-12 * np.eye(k)
    inverse = np.linalg.pinv(cov)
    width = [b.shape[1] for b in blocks]
    ends = np.cumsum([0, *width])
    a, v = np.zeros((ends[-1], ends[-1])), np.zeros(ends[-1])
    for p in range(k):
        for q in range(k):
            a[ends[p] : ends[p + 1], ends[q] : ends[q + 1]] = inverse[p, q] * blocks[p].T @ blocks[q]
            v[ends[p] : ends[p + 1]] += inverse[p, q] * blocks[p].T @ target[q]
    beta = np.linalg.lstsq(a, v, rcond=None)[0]
    return np.array([beta[ends[p] : ends[p + 1]] for p in range(k)]) if full else np.diag(beta)


def multivariate_chain_ladder(cells: DataFrame, keys: list[str], line: str, full: bool = True) -> DataFrame:
    """keys, line, origin_period, latest, ultimate, ibnr: lines of a company developed together.

    ``full`` has a matrix per age (each line from all lines); without it the lines keep their own slope
    and share only the errors' correlation (seemingly unrelated regressions).
    """

    def fit(key, pdf):
        lines, origins, _, c = _lines(pdf, line)
        steps = []
        for j in range(c.shape[2] - 1):
            ok = ~np.isnan(c[:, :, j]).any(axis=0) & ~np.isnan(c[:, :, j + 1]).any(axis=0)
            steps.append(_system(c[:, ok, j], c[:, ok, j + 1], full) if ok.any() else np.eye(len(lines)))
        out = []
        for i, o in enumerate(origins):
            k = int(np.flatnonzero(~np.isnan(c[:, i, :]).any(axis=0)).max())
            x = c[:, i, k]
            for b in steps[k:]:
                x = b @ x
            out += [(a, o, c[n, i, k], x[n]) for n, a in enumerate(lines)]
        df = pd.DataFrame(out, columns=[line, "origin_period", "latest", "ultimate"])
        df["ibnr"] = df["ultimate"] - df["latest"]
        return df

    rows = cells.select(*keys, line, "origin_period", "dev_lag", "value")
    types = dict(cells.dtypes)
    return _by_cohort(rows, keys, fit, f"`{line}` {types[line]}, origin_period date, latest double, ultimate double, ibnr double")


def copula_glm(cells: DataFrame, premium: DataFrame, keys: list[str], line: str, n_draws: int = 200, seed: int = 1) -> DataFrame:
    """keys, draw, value: total reserves of a company's lines, log loss ratios with a Gaussian copula between lines."""
    joined = cells.join(premium, [*keys, line, "origin_period"]).select(*keys, line, "origin_period", "dev_lag", "value", "premium")

    def fit(key, pdf):
        rng = cohort_stream(seed, "copula", key)
        lines, origins, _, c = _lines(pdf, line)
        prem = pdf.groupby([line, "origin_period"])["premium"].first()
        k, w, d = c.shape
        inc = np.diff(np.concatenate([np.zeros((k, w, 1)), c], axis=2), axis=2)
        mean, sigma, resid = np.zeros((k, w, d)), np.zeros(k), np.full((k, w, d), np.nan)
        p = np.array([[prem.get((a, o), np.nan) for o in origins] for a in lines], dtype=float)
        for n in range(k):
            i, j = np.nonzero(inc[n] > 0)
            y = np.log(inc[n, i, j] / p[n, i])
            x = np.zeros((len(i), w + d - 1))
            x[np.arange(len(i)), i] = 1
            x[np.flatnonzero(j > 0), w + j[j > 0] - 1] = 1
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            mean[n] = beta[:w, None] + np.concatenate([[0], beta[w:]])[None, :]
            e = y - x @ beta
            sigma[n] = np.sqrt((e**2).sum() / max(1, len(i) - x.shape[1]))
            resid[n, i, j] = e / max(sigma[n], 1e-12)
        both = ~np.isnan(resid).any(axis=0)
        corr = np.corrcoef(resid[:, both]) if k > 1 and both.sum() > 2 else np.eye(k)
        root = np.linalg.cholesky(np.nan_to_num(corr) * 0.999 + 0.001 * np.eye(k))
        i, j = np.nonzero(np.isnan(c).any(axis=0))
        z = np.einsum("ab,nbc->nac", root, rng.normal(size=(n_draws, k, len(i))))
        total = (np.exp(mean[:, i, j] + sigma[:, None] * z) * p[:, i]).sum(axis=(1, 2)) if len(i) else np.zeros(n_draws)
        return pd.DataFrame({"draw": np.arange(n_draws), "value": total})

    return _by_cohort(joined, keys, fit, "draw bigint, value double")


def odp_log_likelihood(rows: DataFrame, value: str = "increment", mean: str = "fitted", phi: str = "phi") -> DataFrame:
    """Rows with ``elpd``: the over-dispersed Poisson log density of each increment."""

    def run(batches):
        for pdf in batches:
            pdf["elpd"] = odp_lpdf(pdf[value].abs(), pdf[mean].abs().clip(lower=1e-9), pdf[phi])
            yield pdf

    return rows.mapInPandas(run, rows.schema.add("elpd", "double"))


def ml_development(cells: DataFrame, keys: list[str], step: int, estimator: str = "forest", seed: int = 1, trees: int = 20) -> DataFrame:
    """keys, origin_period, latest, ultimate: trees on origin, age and cohort fitted to link ratios of all cohorts at once."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    from rundelta.operators.links import all_links
    from rundelta.operators.methods import latest

    def shaped(df):
        df = df.withColumns({"year": F.year("origin_period").cast("double"), "age": (F.col("dev_lag") / step).cast("double"), "cohort": F.concat_ws("|", *keys)})
        return VectorAssembler(inputCols=["year", "age", "cohort_no"], outputCol="features").transform(index.transform(df))

    links = all_links(cells, keys, step).where("previous > 0")
    index = StringIndexer(inputCol="cohort", outputCol="cohort_no", handleInvalid="keep").fit(links.select(F.concat_ws("|", *keys).alias("cohort")))
    model = (RandomForestRegressor(seed=seed, numTrees=trees, labelCol="ratio") if estimator == "forest" else GBTRegressor(seed=seed, maxIter=trees, labelCol="ratio")).fit(shaped(links))
    ages = links.select(*keys, "dev_lag").distinct()
    base = latest(cells, keys)
    future = base.join(ages, keys).where("dev_lag >= latest_dev")
    grown = model.transform(shaped(future)).groupBy(*keys, "origin_period").agg(F.exp(F.sum(F.ln(F.greatest("prediction", F.lit(1e-9))))).alias("growth"))
    out = base.join(grown, [*keys, "origin_period"], "left")
    return out.withColumn("ultimate", F.col("latest") * F.coalesce("growth", F.lit(1.0))).drop("growth")


def metropolis(cells: DataFrame, premium: DataFrame, keys: list[str], n_draws: int = 1000, seed: int = 1) -> DataFrame:
    """keys, draw, value: posterior reserve of a growth-curve model by random-walk Metropolis.

    Increments are over-dispersed Poisson around premium x loss ratio x growth; log loss ratio
    N(-0.4, sqrt 10), log omega N(ln 1.5, 0.5), log theta N(ln 48, 1).
    """
    joined = cells.join(premium, [*keys, "origin_period"]).select(*keys, "origin_period", "dev_lag", "value", "premium")

    def fit(key, pdf):
        rng = cohort_stream(seed, "growth", key)
        origins, lags, cum = matrix(pdf)
        p = pdf.groupby("origin_period")["premium"].first().loc[origins].to_numpy(dtype=float)
        inc = np.maximum(np.diff(np.concatenate([np.zeros((len(cum), 1)), cum], axis=1), axis=1), 0)
        age = np.maximum(np.array(lags, dtype=float) - 6, 0)
        i, j = np.nonzero(~np.isnan(inc))
        now = np.array([r[~np.isnan(r)][-1] for r in cum])
        at = np.array([age[np.flatnonzero(~np.isnan(r)).max()] for r in cum])
        prior_mean, prior_sd = np.array([-0.4, np.log(1.5), np.log(48.0)]), np.array([np.sqrt(10), 0.5, 1.0])

        def mean(v):
            g = growth(age, np.exp(v[1]), np.exp(v[2]), "loglogistic")
            return p[i] * np.exp(v[0]) * np.diff(np.concatenate([[0], g]))[j]

        def log_post(v, phi):
            mu = np.maximum(mean(v), 1e-9)
            return float((inc[i, j] * np.log(mu) - mu).sum() / phi - 0.5 * (((v - prior_mean) / prior_sd) ** 2).sum())

        v = np.array([np.log(now.sum() / p.sum()), np.log(1.2), np.log(18.0)])
        v = nelder_mead(lambda x: -log_post(x, 1.0), v, rounds=800)[0]
        mu = np.maximum(mean(v), 1e-9)
        phi = max(1e-9, float((((inc[i, j] - mu) ** 2) / mu).sum() / max(1, len(i) - 3)))
        here, out, size = log_post(v, phi), np.zeros(n_draws), np.array([0.05, 0.1, 0.1])
        for n in range(-1000, n_draws * 3):
            trial = v + rng.normal(size=3) * size
            there = log_post(trial, phi)
            accept = np.log(rng.random()) < there - here
            if accept:
                v, here = trial, there
            if n < 0:
                size = size * (1.02 if accept else 0.992)
            elif n % 3 == 0:
                g = growth(at, np.exp(v[1]), np.exp(v[2]), "loglogistic")
                out[n // 3] = (p * np.exp(v[0]) * (1 - g)).sum()
        return pd.DataFrame({"draw": np.arange(n_draws), "value": out})

    return _by_cohort(joined, keys, fit, "draw bigint, value double")


def convergence(draws: DataFrame, keys: list[str], n_chunks: int = 4, value: str = "value") -> DataFrame:
    """keys, r_hat of consecutive chunks of one chain."""
    t = F.ntile(n_chunks).over(Window.partitionBy(*keys).orderBy("draw"))
    parts = draws.withColumn("chunk", t).groupBy(*keys, "chunk").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(*keys).agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n")).select(*keys, F.sqrt((F.col("n") - 1) / F.col("n") + F.col("between") / F.col("within")).alias("r_hat"))
