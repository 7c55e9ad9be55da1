"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rundelta.operators import mack, methods, simulate  # noqa: E402
from rundelta.operators.triangle import Triangle, TriangleMeta  # noqa: E402
from rundelta.plans import catalogue  # noqa: E402

#: Companies of the synthetic portfolio: 155 cells x 3 lines x 3 fields each, about a million cells in all.
COMPANIES = int(os.environ.get("BENCH_COMPANIES", "717"))
QUERIES = ("chain_ladder", "to_incremental", "as_of_restated", "latest_diagonal", "mack_total", "one_year_cdr_total", "replay_ave_cdr", "odp_bootstrap")


def portfolio(spark: SparkSession, companies: int = COMPANIES):
    """Annual staircases: 20 origins, up to 10 ages, three lines, three fields."""
    cells = spark.range(companies * 3 * 3 * 20 * 10).select(
        (F.col("id") % 10).alias("d"), (F.expr("id div 10") % 20).alias("w"), (F.expr("id div 200") % 3).alias("f"), (F.expr("id div 600") % 3).alias("l"), F.expr("id div 1800").alias("c")
    ).where("w + d < 20")
    grown = (1 - F.exp(-0.5 * (F.col("d") + 1))) * (1000 + F.pmod(F.xxhash64("c", "l", "f", "w"), F.lit(5000)))
    return cells.select(
        F.concat(F.lit("company "), F.col("c")).alias("company"),
        F.concat(F.lit("line "), F.col("l")).alias("lob"),
        F.make_date((1990 + F.col("w")).cast("int"), F.lit(1), F.lit(1)).alias("origin_period"),
        ((F.col("d") + 1) * 12).alias("dev_lag"),
        F.make_date((1990 + F.col("w") + F.col("d")).cast("int"), F.lit(12), F.lit(31)).alias("eval_date"),
        F.concat(F.lit("field "), F.col("f")).alias("field"),
        grown.alias("value"),
    )


def quarterly(spark: SparkSession, n: int = 40):
    """One cohort of n origins by n ages, a quarter apart."""
    cells = spark.range(n * n).select((F.col("id") % n).alias("d"), F.expr(f"id div {n}").alias("w")).where(f"w + d < {n}")
    start = F.add_months(F.lit("2010-01-01").cast("date"), (F.col("w") * 3).cast("int"))
    grown = (1 - F.exp(-0.08 * (F.col("d") + 1))) * (50_000 + F.pmod(F.xxhash64("w"), F.lit(20_000)))
    return cells.select(F.lit("one").alias("lob"), start.alias("origin_period"), ((F.col("d") + 1) * 3).alias("dev_lag"), F.last_day(F.add_months(start, (F.col("d") * 3 + 2).cast("int"))).alias("eval_date"), grown.alias("value"))


def timed(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    run = catalogue.queries()
    for name in QUERIES:
        timed(run[name](spark, folder))
        found[name] = timed(run[name](spark, folder))
    files = tempfile.mkdtemp(prefix="bench-")
    portfolio(spark).withColumnRenamed("value", "amount").write.mode("overwrite").parquet(files)
    t = portfolio(spark).cache()
    n = t.count()
    triangle = Triangle(t, TriangleMeta())
    keys = ["company", "lob", "field"]
    cells = t.select(*keys, "origin_period", "dev_lag", "eval_date", "value")
    scaling = {
        "construct": lambda: Triangle.from_long(spark.read.parquet(files), value="amount").df,
        "to_incremental": lambda: triangle.to_incremental().df,
        "as_of_slice": lambda: triangle.as_of("2005-12-31").df,
        "latest_diagonal": lambda: triangle.latest_diagonal().df,
        "aggregate_by_lob": lambda: t.groupBy("lob", "field", "origin_period", "dev_lag").agg(F.sum("value")),
        "chain_ladder_all_cohorts": lambda: methods.chain_ladder(cells, keys, 12),
        "batch_mack_all_cohorts": lambda: mack.mack_totals(cells, keys, 12),
        "odp_bootstrap_40x40_10k_draws": lambda: simulate.odp_bootstrap(quarterly(spark), ["lob"], 10_000),
    }
    for name, df in scaling.items():
        timed(df())
        found[f"{name}@{n}" if "draws" not in name else name] = timed(df())
    shutil.rmtree(files, ignore_errors=True)
    print(json.dumps({"metric": "reserving_headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
