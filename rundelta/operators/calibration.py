"""Residuals of rolling forecasts, their pools by size, and the coverage that pools give when a unit is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import require_none
from rundelta.functions.ranks import medians, ranked, with_ntile
from rundelta.functions.sizes import small
from rundelta.functions.storage import kept


def scale_of(predicted: Column, size: Column, floor: tuple[float, float] = (0.01, 1.0)) -> Column:
    return F.greatest(F.abs(predicted), floor[0] * size, F.lit(floor[1]))


def rolling_residuals(forecasts: DataFrame, actuals: DataFrame, unit: list[str], floor: tuple[float, float] = (0.01, 1.0)) -> DataFrame:
    """unit, cutoff, target, horizon, predicted, actual, size, scale, residual of every forecast.

    ``forecasts``: unit, cutoff, target (dates), horizon, predicted, size; ``actuals``: unit, eval_date, value.  A
    forecast meets the last value observed up to its target, and only one observed after its cutoff: an as-of join,
    made by one window over a unit's forecasts and values in order of dates.  Without such a value, or with one
    that is not finite, ``residual`` is null.
    """
    asked = forecasts.select(*unit, F.col("target").alias("at"), F.lit(1).alias("kind"), F.struct("cutoff", "target", "horizon", "predicted", "size").alias("f"), F.lit(None).cast("struct<seen:date,value:double>").alias("a"))
    shown = actuals.select(*unit, F.col("eval_date").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["f"].dataType).alias("f"), F.struct(F.col("eval_date").alias("seen"), F.col("value").cast("double").alias("value")).alias("a"))
    w = Window.partitionBy(*unit).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(shown).withColumn("last", F.last("a", ignorenulls=True).over(w)).where("kind = 1")
    actual = F.when(F.col("last.seen") > F.col("f.cutoff"), F.col("last.value"))
    out = met.select(*unit, "f.*", actual.alias("actual")).withColumn("scale", scale_of(F.col("predicted"), F.col("size"), floor))
    z = (F.col("actual") - F.col("predicted")) / F.col("scale")
    return out.withColumn("residual", F.when(~F.isnan(z) & (F.abs(z) != float("inf")), z))


def with_strata(residuals: DataFrame, unit: list[str], n_strata: int = 4, least: int = 40) -> DataFrame:
    """Finite residuals with the ``stratum`` of their unit's size, larger strata first; ties of size go by unit.

    A stratum with fewer than ``least`` residuals is refused, which runs a job.
    """
    used = kept(residuals.where("residual is not null"), "residuals")
    units = used.groupBy(*unit).agg(F.min("size").alias("unit_size"))
    strata = with_ntile(units, ["unit_size", *unit], n_strata, "stratum").drop("unit_size")
    out = used.join(strata, unit)
    thin = out.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    require_none(thin.select("stratum", "n", F.lit("empty_residual_pool").alias("reason")))
    return out


def centred_pools(residuals: DataFrame) -> DataFrame:
    """Residuals less their stratum's median, as ``centred``."""
    middle = medians(residuals, ["stratum"], "residual", "middle").select("stratum", "middle")
    return residuals.join(middle, "stratum").withColumn("centred", F.col("residual") - F.col("middle"))


def _places(p: Column, m: Column) -> Column:
    """(low, part): where the median-unbiased (type 8) quantile lies among m sorted values."""
    at = F.greatest(F.lit(1.0), F.least(m.cast("double"), (m + 1 / 3) * p + 1 / 3))
    return F.struct(F.floor(at).cast("long").alias("low"), (at - F.floor(at)).alias("part"))


def leave_one_out_coverage(residuals: DataFrame, unit: list[str], levels: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """horizon, nominal, empirical, n: how often intervals from the other units of a stratum hold a forecast's outcome.

    Without a unit, the k-th value of a stratum is the one of rank k plus the number of the unit's own values that
    come before it.  So one order of the residuals serves all units: each asks for a few ranks, all units together
    for few different ones, and no unit meets the others' residuals.
    """
    placed = kept(ranked(residuals.select(*unit, "stratum", "horizon", "predicted", "actual", "scale", "residual"), ["stratum", "residual"], "rank"), "loo-ranks")
    sizes = placed.groupBy("stratum").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = placed.join(sizes, "stratum").withColumn("rank", F.col("rank") - F.col("first") + 1)
    own = rows.groupBy("stratum", *unit, "n").agg(F.array_sort(F.collect_list("rank")).alias("own")).withColumn("m", F.col("n") - F.size("own")).where("m > 0")
    names = {"middle": 0.5} | {f"{side}{i}": p for i, level in enumerate(levels) for side, p in (("lo", (1 - level) / 2), ("hi", 1 - (1 - level) / 2))}
    # The median of m values is their type-8 quantile at one half: the mean of the two in the middle.
    asked = own.select("stratum", *unit, "own", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), _places(F.lit(p), F.col("m")).alias("at")) for k, p in names.items()])).alias("q"))
    rank = lambda k: k + F.size(F.filter(F.transform("own", lambda r, i: r - i - 1), lambda free: free < k))
    asked = asked.select("stratum", *unit, "q.name", F.col("q.at.part").alias("part"), rank(F.col("q.at.low")).alias("low"), rank(F.col("q.at.low") + 1).alias("high"))
    asked = kept(asked, "loo-asked")
    wanted = asked.select("stratum", F.explode(F.array("low", "high")).alias("rank")).distinct()
    values = small(kept(rows.select("stratum", "rank", "residual").join(wanted, ["stratum", "rank"]), "loo-values"), 24)
    found = asked.join(values.select("stratum", F.col("rank").alias("low"), F.col("residual").alias("v0")), ["stratum", "low"])
    found = found.join(values.select("stratum", F.col("rank").alias("high"), F.col("residual").alias("v1")), ["stratum", "high"], "left")
    value = F.when(F.col("part") > 0, F.col("v0") + F.col("part") * (F.col("v1") - F.col("v0"))).otherwise(F.col("v0"))
    bounds = found.groupBy("stratum", *unit).agg(*[F.max(F.when(F.col("name") == k, value)).alias(k) for k in names])
    both = rows.join(bounds, ["stratum", *unit])
    z = (F.col("actual") - F.col("predicted")) / F.col("scale") + F.col("middle")
    held = F.array(*[F.struct(F.lit(level).alias("nominal"), ((z >= F.col(f"lo{i}")) & (z <= F.col(f"hi{i}"))).alias("held")) for i, level in enumerate(levels)])
    out = both.select("horizon", F.explode(held).alias("x")).groupBy("horizon", "x.nominal")
    return out.agg(F.avg(F.col("x.held").cast("double")).alias("empirical"), F.count(F.lit(1)).alias("n"))
