"""The index space of a fit, and held-out cells placed in it or turned down with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import require_none

#: Why a held-out cell has no place in the training grid, in the order in which it is looked at.
INDEX_REASONS = ("duplicate", "unknown_cohort", "unknown_origin", "off_grain", "dev_beyond_trained")


def training_index(cells: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, origin_period, dev_lag, w, d, value, prev_value of the cells of a fit.

    ``w`` counts a cohort's origins and ``d`` its ages, both from 1.  ``prev_value`` is the value one age before
    in the same origin: 0 at the first age, null behind a hole.  Duplicates and ages off the grain raise.
    """
    cell = [*keys, "origin_period", "dev_lag"]
    counted = cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    off = (F.col("dev_lag") % step != 0) | (F.col("dev_lag") <= 0)
    require_none(counted.where((F.col("n") > 1) | off).select(*cell, F.when(off, "off_grain").otherwise("duplicate").alias("reason")))
    w = Window.partitionBy(*keys, "origin_period").orderBy("dev_lag").rangeBetween(-step, -step)
    d = (F.col("dev_lag") / step).cast("int")
    prev = F.when(d == 1, F.lit(0.0)).otherwise(F.max("value").over(w))
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("origin_period"))
    return cells.select(*cell, place.alias("w"), d.alias("d"), F.col("value").cast("double").alias("value"), prev.alias("prev_value"))


def index_into(held: DataFrame, index: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Held-out cells (keys, origin_period, dev_lag, value) with w, d, prev_value of the training grid, and ``reason``.

    Origins and ages are looked up in the cohort's own grid; nothing is matched across cohorts.  A cell with a
    reason (see ``INDEX_REASONS``) has no place: a cell that a fit cannot score is a row, never a silent misfit.
    ``prev_value`` comes from the training cells only.
    """
    cohort = index.groupBy(*keys).agg(F.max("d").alias("n_d"))
    origins = index.groupBy(*keys, "origin_period").agg(F.first("w").alias("w"))
    cell = Window.partitionBy(*keys, "origin_period", "dev_lag")
    before = index.select(*keys, "origin_period", (F.col("dev_lag") + step).alias("dev_lag"), F.col("value").alias("prev_value"))
    out = held.select(*keys, "origin_period", "dev_lag", "value").withColumn("copies", F.count(F.lit(1)).over(cell))
    out = out.join(cohort, keys, "left").join(origins, [*keys, "origin_period"], "left").join(before, [*keys, "origin_period", "dev_lag"], "left")
    d = (F.col("dev_lag") / step).cast("int")
    found = (F.col("copies") > 1, F.col("n_d").isNull(), F.col("w").isNull(), (F.col("dev_lag") % step != 0) | (F.col("dev_lag") <= 0), d > F.col("n_d"))
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, r in zip(found, INDEX_REASONS, strict=True)])
    placed = reason.isNull()
    return out.select(*keys, "origin_period", "dev_lag", "value", F.when(placed, F.col("w")).alias("w"), F.when(placed, d).alias("d"), F.when(placed & (d == 1), F.lit(0.0)).when(placed, F.col("prev_value")).alias("prev_value"), reason.alias("reason"))


def collapsed(cells: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """The values of ``keep`` that more than one cohort of ``keys`` shares: n_cohorts, an example of two, reason."""
    cohorts = cells.select(*keys).distinct()
    shown = F.slice(F.array_sort(F.collect_list(F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]))), 1, 2)
    found = cohorts.groupBy(*keep).agg(F.count(F.lit(1)).alias("n_cohorts"), shown.alias("example"))
    return found.where("n_cohorts > 1").withColumn("reason", F.lit("keys_collapse"))


def narrowed_to(cells: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Cells keyed by a subset of their columns; raises where two cohorts would become one.  Runs a job."""
    require_none(collapsed(cells, keys, keep))
    return cells.drop(*[k for k in keys if k not in keep])
