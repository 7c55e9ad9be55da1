"""Several lines of a company: aligned triangles, and draws whose totals are taken within each draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import require_none


def misaligned(cells: DataFrame, keys: list[str], line: str) -> DataFrame:
    """keys, line, n_missing, n_extra, reason of the lines that show other cells than their company's first line.

    A company with a single line is one row, as dependence between lines needs two.
    """
    first = F.min(line).over(Window.partitionBy(*keys))
    shown = cells.where("value is not null").select(*keys, line, "origin_period", "dev_lag").distinct().withColumn("lead", first)
    lead = shown.where(F.col(line) == F.col("lead")).select(*keys, "origin_period", "dev_lag").withColumn("there", F.lit(1))
    lines = shown.select(*keys, line).distinct().withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    size = lead.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lead"))
    met = shown.join(lead, [*keys, "origin_period", "dev_lag"], "left").groupBy(*keys, line).agg(F.count("there").alias("n_met"), F.count(F.lit(1)).alias("n"))
    out = lines.join(met, [*keys, line]).join(size, keys)
    out = out.select(*keys, line, (F.col("n_lead") - F.col("n_met")).alias("n_missing"), (F.col("n") - F.col("n_met")).alias("n_extra"), F.when(F.col("n_lines") < 2, "single_line").when((F.col("n_lead") != F.col("n_met")) | (F.col("n") != F.col("n_met")), "misaligned").alias("reason"))
    return out.where("reason is not null")


def unaligned_draws(draws: DataFrame, keys: list[str], line: str) -> DataFrame:
    """keys, line, origin_period, n_draws, reason of targets that lack draws which their company has, or hold some twice."""
    target = draws.groupBy(*keys, line, "origin_period").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("draw").alias("n_draws"))
    most = draws.groupBy(*keys).agg(F.count_distinct("draw").alias("all_draws"))
    origins = draws.select(*keys, "origin_period").distinct()
    lines = draws.select(*keys, line).distinct()
    # Lines by origins of one company: its targets, as a complete grid has them.
    grid = lines.join(origins, keys).join(most, keys).join(target, [*keys, line, "origin_period"], "left")
    reason = F.when(F.col("n_rows").isNull(), "missing_line").when(F.col("n_rows") > F.col("n_draws"), "duplicate").when(F.col("n_draws") < F.col("all_draws"), "missing_draws")
    return grid.select(*keys, line, "origin_period", F.coalesce("n_draws", F.lit(0)).alias("n_draws"), reason.alias("reason")).where("reason is not null")


def with_totals(draws: DataFrame, keys: list[str], line: str, value: str = "value", check: bool = True) -> DataFrame:
    """keys, label, line, origin_period, draw, value: each target, each line's total and the grand total of every draw.

    Totals are sums within a draw, so they carry the dependence between lines.  An unknown value makes its totals
    unknown.  With ``check``, lines that do not have all draws of their company raise, which runs a job.
    """
    if check:
        require_none(unaligned_draws(draws, keys, line))
    whole = F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))
    sums = draws.groupingSets([[*keys, "draw", line], [*keys, "draw"]], *keys, "draw", line).agg(whole.alias("total"), F.grouping(line).alias("grand"))
    sums = sums.select(*keys, F.when(F.col("grand") == 1, F.lit("total")).otherwise(F.concat(F.col(line), F.lit("/total"))).alias("label"), line, F.lit(None).cast("date").alias("origin_period"), "draw", F.col("total").alias(value))
    each = draws.select(*keys, F.concat(F.col(line), F.lit("/"), F.col("origin_period").cast("string")).alias("label"), line, "origin_period", "draw", value)
    return each.unionByName(sums)


def target_summary(totals: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, label, n, mean, sd, least, most of each target's draws."""
    v: Column = F.col(value)
    return totals.groupBy(*keys, "label").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"))
