"""Exact ranks, strata and medians of a whole table, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.functions.storage import kept


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Rows with their place (from 1) in an order; rows equal in it follow a hash of all their columns.

    Rows are dealt by ranges of the order and written once, as a second dealing could cut elsewhere;
    places are those within a range after the counts of the ranges before it (a row per range).
    """
    by = [*[F.col(c) if isinstance(c, str) else c for c in order], F.xxhash64(*df.columns)]
    rows = kept(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranks")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*by)))
    return rows.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


def with_ntile(df: DataFrame, order: list[Column | str], n: int, name: str) -> DataFrame:
    """Rows with their bin of ``n`` (from 1), sizes as even as can be, larger bins first."""
    rows = ranked(df, order, "_rank")
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_total")))
    each, rest = F.floor(F.col("_total") / n), F.col("_total") % n
    at, cut = F.col("_rank") - 1, F.col("_total") % n * (F.floor(F.col("_total") / n) + 1)
    bin_ = F.when(at < cut, F.floor(at / (each + 1))).otherwise(rest + F.floor((at - cut) / F.greatest(each, F.lit(1)))) + 1
    return rows.crossJoin(total).withColumn(name, bin_.cast("int")).drop("_rank", "_total")


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, n and the exact median of each group's non-null values; one row without keys."""
    rows = ranked(df.where(F.col(value).isNotNull()).select(*keys, value), [*keys, value], "_rank")
    sizes = rows.groupBy(*keys).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]
    # A row a group: as many as there are groups, so no hint.
    met = rows.alias("r").join(sizes.alias("s"), same) if keys else rows.alias("r").crossJoin(F.broadcast(sizes).alias("s"))
    at = F.col("r._rank") - F.col("s._first")
    middle = met.where((at == F.floor((F.col("s.n") - 1) / 2)) | (at == F.floor(F.col("s.n") / 2)))
    return middle.groupBy(*[F.col(f"s.`{k}`").alias(k) for k in keys]).agg(F.avg(F.col(f"r.`{value}`")).alias(name), F.first("s.n").alias("n"))
