"""Reserving methods over all cohorts: chain ladder, Bornhuetter-Ferguson, Benktander, Cape Cod, tails."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import Refusal
from rundelta.operators.links import LinkRules, link_factors, select_links
from rundelta.operators.triangle import month_number

CURVES = ("exponential", "inverse_power", "weibull")


def latest(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, origin_period, latest_dev, latest: one aggregate, no window."""
    return cells.groupBy(*keys, "origin_period").agg(F.max("dev_lag").alias("latest_dev"), F.max_by("value", F.struct("dev_lag", "eval_date")).alias("latest"))


def pattern(factors: DataFrame, keys: list[str], tail: DataFrame | None = None) -> DataFrame:
    """keys, dev_lag, factor, cdf (to ultimate) and pct_reported; ``tail`` has keys and tail_factor."""
    w = Window.partitionBy(*keys).orderBy(F.col("dev_lag").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = factors.withColumn("cdf", F.exp(F.sum(F.ln("factor")).over(w)))
    if tail is not None:
        out = out.join(tail.select(*keys, "tail_factor"), keys, "left").withColumn("cdf", F.col("cdf") * F.coalesce("tail_factor", F.lit(1.0))).drop("tail_factor")
    return out.withColumn("pct_reported", 1 / F.col("cdf"))


def developed(cells: DataFrame, keys: list[str], step: int, rules: LinkRules | None = None, average: str = "volume", tail: DataFrame | None = None) -> DataFrame:
    """keys, origin_period, latest_dev, latest, cdf, beta (share developed): what every method starts from."""
    factors = link_factors(select_links(cells, keys, step, rules), keys, average)
    shape = pattern(factors, keys, tail).select(*keys, F.col("dev_lag").alias("latest_dev"), "cdf")
    out = latest(cells, keys).join(shape, [*keys, "latest_dev"], "left")
    end = F.lit(1.0)
    if tail is not None:
        out = out.join(tail.select(*keys, "tail_factor"), keys, "left")
        end = F.coalesce("tail_factor", F.lit(1.0))
    out = out.withColumn("cdf", F.coalesce("cdf", end)).withColumn("beta", 1 / F.col("cdf"))
    return out.select(*keys, "origin_period", "latest_dev", "latest", "cdf", "beta")


def _with_ibnr(df: DataFrame) -> DataFrame:
    return df.withColumn("ibnr", F.col("ultimate") - F.col("latest"))


def chain_ladder(cells: DataFrame, keys: list[str], step: int, rules: LinkRules | None = None, average: str = "volume", tail: DataFrame | None = None) -> DataFrame:
    out = developed(cells, keys, step, rules, average, tail)
    return _with_ibnr(out.withColumn("ultimate", F.col("latest") * F.col("cdf")))


def _with_premium(df: DataFrame, premium: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(premium.select(*keys, "origin_period", "premium"), [*keys, "origin_period"])


def bornhuetter_ferguson(cells: DataFrame, premium: DataFrame, keys: list[str], step: int, expected_loss_ratio: float, **options) -> DataFrame:
    """Latest plus the undeveloped share of expected losses."""
    out = _with_premium(developed(cells, keys, step, **options), premium, keys)
    return _with_ibnr(out.withColumn("ultimate", F.col("latest") + (1 - F.col("beta")) * F.col("premium") * expected_loss_ratio))


def benktander(cells: DataFrame, premium: DataFrame, keys: list[str], step: int, expected_loss_ratio: float, n_iters: int = 2, **options) -> DataFrame:
    """``n_iters`` Bornhuetter-Ferguson steps in closed form: L (1 + q + ... + q^(n-1)) + q^n E with q = 1 - beta."""
    if not 1 <= n_iters <= 10_000:
        raise Refusal("invalid_option", f"n_iters {n_iters}")
    out = _with_premium(developed(cells, keys, step, **options), premium, keys)
    q = 1 - F.col("beta")
    return _with_ibnr(out.withColumn("ultimate", F.col("latest") * (1 - F.pow(q, F.lit(n_iters))) / F.col("beta") + F.pow(q, F.lit(n_iters)) * F.col("premium") * expected_loss_ratio))


def cape_cod(cells: DataFrame, premium: DataFrame, keys: list[str], step: int, decay: float = 1.0, trend: float = 0.0, n_iters: int = 1, origin_months: int = 12, **options) -> DataFrame:
    """Expected loss ratios from the cohort's own data, weighted by ``decay`` per origin period of distance."""
    out = _with_premium(developed(cells, keys, step, **options), premium, keys)
    months = month_number(F.col("origin_period"))
    valuation = F.max(months + F.col("latest_dev")).over(Window.partitionBy(*keys))
    out = out.withColumns({"m": months, "trend_factor": F.pow(F.lit(1.0 + trend), (valuation - months - origin_months) / 12)})
    other = out.select(*keys, F.col("m").alias("k"), (F.col("latest") * F.col("trend_factor")).alias("loss"), (F.col("premium") * F.col("beta")).alias("used"))
    weight = F.pow(F.lit(float(decay)), F.abs(F.col("m") - F.col("k")) / origin_months)
    ratio = out.select(*keys, "m").join(other, keys).groupBy(*keys, "m").agg((F.sum(weight * F.col("loss")) / F.sum(weight * F.col("used"))).alias("trended_loss_ratio"))
    out = out.join(ratio, [*keys, "m"]).withColumn("expected_loss_ratio", F.col("trended_loss_ratio") / F.col("trend_factor"))
    q, expected = 1 - F.col("beta"), F.col("premium") * F.col("expected_loss_ratio")
    n = F.lit(n_iters)
    return _with_ibnr(out.withColumn("ultimate", F.col("latest") * (1 - F.pow(q, n)) / F.col("beta") + F.pow(q, n) * expected).drop("m"))


def totals(result: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by cohort and in all (``rollup``); the grand total has null keys."""
    return result.rollup(*keys).agg(*[F.sum(c).alias(c) for c in ("latest", "ultimate", "ibnr")])


# --- tails ------------------------------------------------------------------------------------


def curve_tail(factors: DataFrame, keys: list[str], step: int, curve: str, n_steps: int = 100, fit_lags: list[int] | None = None) -> DataFrame:
    """keys, intercept, slope, n_fit, tail_factor, reason.

    A line is fitted to the transformed factors above 1.00001 by age number; the tail is the product of
    the curve over the ages beyond.  ``reason`` is ``not_identified`` below two points and
    ``tail_not_decaying`` where the slope is not that of a decaying curve; the tail is null then.
    """
    if curve not in CURVES or not 1 <= n_steps <= 10_000:
        raise Refusal("invalid_option", f"curve {curve!r}, {n_steps} steps")
    t = F.col("dev_lag") / step
    usable = factors.where("factor > 1.00001")
    if fit_lags:
        usable = usable.where(F.col("dev_lag").isin(fit_lags))
    excess = F.col("factor") - 1
    y = F.ln(F.ln(F.col("factor") / excess)) if curve == "weibull" else F.ln(excess)
    x = t if curve == "exponential" else F.ln(t)
    last = factors.groupBy(*keys).agg((F.max("dev_lag") / step).cast("int").alias("n"))
    usable = usable.select(*keys, y.alias("y"), x.alias("x"))
    fit = usable.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("y").alias("n_fit"))
    out = last.join(fit, keys, "left")
    decays = {"exponential": F.col("slope") < 0, "inverse_power": F.col("slope") < -1, "weibull": F.col("slope") > 0}[curve]
    term = {
        "exponential": "exp(intercept + slope * t)",
        "inverse_power": "exp(intercept) * pow(t, slope)",
        "weibull": "1 / (exp(exp(intercept) * pow(t, slope)) - 1)",
    }[curve]
    product = F.expr(f"exp(aggregate(sequence(n + 1, n + {n_steps}), 0D, (a, t) -> a + ln(1 + {term})))")
    reason = F.when(F.coalesce("n_fit", F.lit(0)) < 2, "not_identified").when(~F.coalesce(decays, F.lit(False)), "tail_not_decaying")
    return out.withColumn("reason", reason).withColumn("tail_factor", F.when(F.col("reason").isNull(), product)).select(*keys, "intercept", "slope", F.coalesce("n_fit", F.lit(0)).cast("bigint").alias("n_fit"), "tail_factor", "reason")


def constant_tail_steps(tail_factor: float, n_steps: int, decay: float = 0.5, terms: int = 1000) -> list[float]:
    """A tail factor as ``n_steps`` steps ``1 + x decay^k``, the last one taking the remainder.

    ``x`` is the positive root of ``qa x^2 + qb x = ln F`` with the sums of ``decay^2k`` and ``decay^k``.
    """
    if not tail_factor > 0 or not 0 < decay < 1 or n_steps < 1:
        raise Refusal("invalid_option", "tail factor, decay or steps")
    qb = sum(decay**k for k in range(terms))
    qa = sum(decay ** (2 * k) for k in range(terms))
    root = qb * qb + 4 * qa * math.log(tail_factor)
    if root < 0:
        raise Refusal("tail_not_decaying", "no real root")
    x = (-qb + math.sqrt(root)) / (2 * qa)
    steps = [1 + x * decay**k for k in range(n_steps - 1)]
    return [*steps, tail_factor / math.prod(steps)]


def constant_tail(cohorts: DataFrame, keys: list[str], tail_factor: float) -> DataFrame:
    return cohorts.select(*keys).distinct().withColumn("tail_factor", F.lit(float(tail_factor)))
