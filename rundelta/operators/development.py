"""A cohort's development with its tail as ages of their own: what patterns and projections read.

The age axis goes on past the data, or replaces its last links from an attachment age on.  Every cohort gets at
least as many tail ages as its origins have reached, so each origin finds its own age; the last one takes the rest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import Refusal
from rundelta.operators.methods import CURVES, curve_tail, latest

#: Terms of the series that share a constant tail out.
TERMS = 1000


@dataclass(frozen=True)
class Tail:
    """A constant tail factor, shared out by ``decay``, or a curve fitted to the factors.

    ``attach_lag`` is the first age whose link the tail gives (default: the one after the last link), ``rows`` how
    many ages it shows at least, ``n_steps`` how far a curve runs, ``fit_lags`` the ages that it is fitted to.
    """

    constant: float | None = None
    curve: str | None = None
    attach_lag: int | None = None
    rows: int = 1
    decay: float = 0.5
    n_steps: int = 100
    fit_lags: tuple[int, ...] | None = None

    def __post_init__(self):
        ok = (self.constant is None) != (self.curve is None) and self.rows >= 1 and 0 < self.decay < 1 and 1 <= self.n_steps <= 10_000
        ok = ok and (self.constant is None or self.constant > 0) and (self.curve is None or self.curve in CURVES) and self.rows <= self.n_steps
        if not ok:
            raise Refusal("invalid_option", str(self))

    def first_share(self) -> float:
        """x, where the product of ``1 + x decay^k`` is the constant tail in the second-order sense of its logarithm."""
        qb, qa = sum(self.decay**k for k in range(TERMS)), sum(self.decay ** (2 * k) for k in range(TERMS))
        root = qb * qb + 4 * qa * math.log(self.constant)
        if root < 0:
            raise Refusal("tail_not_decaying", "no real root")
        return (-qb + math.sqrt(root)) / (2 * qa)


_TERM = {"exponential": "exp(intercept + slope * t)", "inverse_power": "exp(intercept) * pow(t, slope)", "weibull": "1 / (exp(exp(intercept) * pow(t, slope)) - 1)"}


def development(factors: DataFrame, keys: list[str], step: int, tail: Tail) -> DataFrame:
    """keys, dev_lag, factor, source (``data`` or ``tail``), cdf, reason.

    A cohort whose tail fails (a curve that is not identified or does not decay, an attachment beyond the age after
    its last link) keeps its data rows, without a tail and with the reason.
    """
    ends = factors.groupBy(*keys).agg((F.max("dev_lag") + step).alias("end"))
    if tail.curve:
        fit = curve_tail(factors, keys, step, tail.curve, tail.n_steps, list(tail.fit_lags) if tail.fit_lags else None)
        ends = ends.join(fit.select(*keys, "intercept", "slope", "reason"), keys, "left")
    else:
        ends = ends.withColumn("reason", F.lit(None).cast("string"))
    attach = F.col("end") if tail.attach_lag is None else F.lit(tail.attach_lag).cast("bigint")
    ends = ends.withColumn("attach", attach)
    ends = ends.withColumn("reason", F.coalesce("reason", F.when((F.col("attach") > F.col("end")) | (F.col("attach") < step) | (F.col("attach") % step != 0), "not_supported")))
    ends = ends.withColumn("m", F.greatest(F.lit(tail.rows), ((F.col("end") - F.col("attach")) / step + 1).cast("int")))
    if tail.curve:
        term = f"transform(sequence(0, {tail.n_steps} - 1), i -> (attach div {step} + i))"
        steps = f"transform({term}, t -> 1 + {_TERM[tail.curve]})"
    else:
        x = tail.first_share()
        steps = f"transform(sequence(0, m - 1), i -> 1 + {x!r}D * pow({tail.decay!r}D, i))"
    good = F.col("reason").isNull()
    made = ends.where(good).withColumn("all", F.expr(steps))
    rest = "aggregate(slice(all, m, size(all)), 1D, (a, x) -> a * x)" if tail.curve else f"{float(tail.constant or 1)!r}D / aggregate(slice(all, 1, m - 1), 1D, (a, x) -> a * x)"
    made = made.withColumn("steps", F.expr(f"concat(slice(all, 1, m - 1), array({rest}))"))
    tails = made.select(*keys, "attach", F.posexplode("steps").alias("i", "factor")).select(*keys, (F.col("attach") + F.col("i") * step).alias("dev_lag"), "factor", F.lit("tail").alias("source"), F.lit(None).cast("string").alias("reason"))
    data = factors.select(*keys, "dev_lag", "factor").join(ends.select(*keys, "attach", "reason"), keys).where(~good | (F.col("dev_lag") < F.col("attach")))
    both = data.select(*keys, "dev_lag", "factor", F.lit("data").alias("source"), "reason").unionByName(tails)
    ahead = Window.partitionBy(*keys).orderBy(F.col("dev_lag").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("cdf", F.product("factor").over(ahead)).select(*keys, "dev_lag", "factor", "source", "cdf", "reason")


def projected(cells: DataFrame, pattern: DataFrame, keys: list[str]) -> DataFrame:
    """keys, origin_period, latest_dev, latest, ultimate, ibnr: chain ladder along a development."""
    at = pattern.select(*keys, F.col("dev_lag").alias("latest_dev"), "cdf")
    out = latest(cells, keys).join(at, [*keys, "latest_dev"], "left").withColumn("ultimate", F.col("latest") * F.coalesce("cdf", F.lit(1.0)))
    return out.select(*keys, "origin_period", "latest_dev", "latest", "ultimate", (F.col("ultimate") - F.col("latest")).alias("ibnr"))
