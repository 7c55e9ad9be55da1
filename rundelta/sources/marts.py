"""Triangles from the star-schema tables: orders are written business, line items are payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rundelta.functions.storage import kept
from rundelta.operators.triangle import MONTHS, Triangle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TRUNC = {"Y": "year", "Q": "quarter", "M": "month"}


def payments(spark: SparkSession, sf_dir: str, grain: str = "Y", origin_grain: str | None = None) -> DataFrame:
    """A row per line item shipped in its order's year or later: segment, periods, exact decimal amounts.

    Orders meet their customers first and a line is cut to its key, its period and its amounts before it is joined,
    so lines are moved once, and narrow.
    """
    shipped, ordered = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    end = F.last_day(F.add_months(F.trunc(shipped, _TRUNC[grain]), MONTHS[grain] - 1))
    paid = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", end.alias("eval_date"), paid.alias("paid_loss"), F.col("l_quantity").cast("decimal(12,2)").alias("claim_count"), (F.col("l_returnflag") != "R").alias("stays"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.trunc(ordered, _TRUNC[origin_grain or grain]).alias("origin_period"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("lob"))
    written = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "lob", "origin_period")
    joined = lines.join(written, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("lob", "origin_period", "eval_date", "paid_loss", "claim_count", "stays").where("year(eval_date) >= year(origin_period)")


def sums(spark: SparkSession, sf_dir: str, grain: str, origin_grain: str | None, fields: tuple[str, ...], *more: str) -> DataFrame:
    """Decimal sums by segment, origin, age and date (and ``more``), kept: line items are read and joined once a query.

    There are as many rows as segments and pairs of periods, however many line items.  Periods of ages are counted
    on the calendar, so the first cell of an origin is at its own length.
    """
    end, start = F.col("eval_date"), F.col("origin_period")
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1
    rows = payments(spark, sf_dir, grain, origin_grain).withColumn("dev_lag", months.cast("bigint")).where("dev_lag > 0")
    return kept(rows.groupBy("lob", "origin_period", "dev_lag", "eval_date", *more).agg(*[F.sum(f).alias(f) for f in fields]), "increments")


def _incremental(rows: DataFrame, fields: tuple[str, ...], grain: str, origin_grain: str | None = None) -> Triangle:
    return Triangle.from_long(rows, fields=list(fields), strict=False, origin_grain=origin_grain or grain, dev_grain=grain, measure="incremental")


def increments(spark: SparkSession, sf_dir: str, grain: str = "Y", origin_grain: str | None = None, fields: tuple[str, ...] = ("paid_loss",)) -> Triangle:
    """Incremental triangle by market segment; amounts are summed as decimals and cast once."""
    return _incremental(sums(spark, sf_dir, grain, origin_grain, fields), fields, grain, origin_grain)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lob, origin_period, dev_lag, eval_date, value: yearly cumulative paid losses (a full staircase per segment)."""
    return increments(spark, sf_dir).to_cumulative().df.select("lob", "origin_period", "dev_lag", "eval_date", "value")


def premiums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lob, origin_period, premium: order totals by segment and year, kept as ``sums`` are."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    totals = joined.groupBy(F.col("c_mktsegment").alias("lob"), F.trunc(F.col("o_orderdate").cast("date"), "year").alias("origin_period")).agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("premium"))
    return kept(totals, "premiums")


def restated(spark: SparkSession, sf_dir: str) -> Triangle:
    """Cells with a second observation a year later: returned line items are taken out of it."""
    rows, key = sums(spark, sf_dir, "Y", None, ("paid_loss",), "stays"), ["lob", "origin_period", "dev_lag", "eval_date"]
    first = _incremental(rows.groupBy(*key).agg(F.sum("paid_loss").alias("paid_loss")), ("paid_loss",), "Y")
    again = rows.where("stays").select("lob", "origin_period", "dev_lag", F.add_months("eval_date", 12).alias("eval_date"), F.col("paid_loss").cast("double").alias("value"))
    return Triangle(first.df.unionByName(again.withColumn("field", F.lit("paid_loss"))), first.meta)


def load_mart(df: DataFrame, lines: list[str] | None = None, companies: list[str] | None = None, fields: tuple[str, ...] = ("paid_loss", "incurred_loss", "bulk_loss", "case_reserve", "earned_premium", "earned_premium_direct"), version: str | None = None) -> Triangle:
    """A reserving mart (one row per company, line, accident year and age in years) as a triangle.

    Predicates come before the projection, so they reach the Parquet scan; ``reported_loss`` is
    incurred less bulk.
    """
    if lines:
        df = df.where(F.col("line_of_business").isin(lines))
    if companies:
        df = df.where(F.col("company_code").isin(companies))
    df = df.withColumnsRenamed({"cum_paid_loss": "paid_loss", "earned_prem_net": "earned_premium", "earned_prem_direct": "earned_premium_direct"})
    df = df.withColumns({"reported_loss": F.col("incurred_loss") - F.col("bulk_loss"), "origin_period": F.make_date("accident_year", F.lit(1), F.lit(1)), "dev_lag": F.col("development_age") * 12, "eval_date": F.make_date("statement_year", F.lit(12), F.lit(31))})
    keys = ["company_code", "line_of_business"]
    if version:
        df = df.withColumn("source_version", F.lit(version))
        keys.append("source_version")
    names = [*fields, "reported_loss"]
    return Triangle.from_long(df.select(*keys, "origin_period", "dev_lag", "eval_date", *names), fields=names, strict=False, units="thousands")
