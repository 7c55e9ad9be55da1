"""Observations as a stream: the latest restatement of every cell, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ["lob", "origin_period", "dev_lag"]


def latest_restatements(observations: DataFrame, lateness: str = "3650 days") -> DataFrame:
    """Each cell's value at its latest evaluation date, over a stream or a table.

    A stream is watermarked on the evaluation date and an observation that comes twice counts once;
    the state is one row per cell.
    """
    rows = observations.withColumn("known_at", F.col("eval_date").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("known_at", lateness).dropDuplicatesWithinWatermark([*CELL, "eval_date", "value"])
    return rows.groupBy(*CELL).agg(F.max("eval_date").alias("eval_date"), F.max_by("value", "eval_date").alias("value"))


def run_available(spark: SparkSession, folder: str, schema, checkpoint: str) -> DataFrame:
    """Read all files of a folder as a stream, fold them into the snapshot and return it.

    A batch writes the cells that it changed, under its number, so a batch that is run again replaces
    its own rows; the snapshot is each cell's row of the last batch that changed it.
    """
    out = f"{checkpoint}/changed"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)
    changed = latest_restatements(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/{number:09d}")

    query = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.lastProgress:
        return spark.createDataFrame([], changed.schema)
    rows = spark.read.schema(changed.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(out)
    last = F.max_by(F.struct("eval_date", "value"), "batch")
    return rows.groupBy(*CELL).agg(last.alias("row")).select(*CELL, "row.eval_date", "row.value")


def event_windows(events: DataFrame, length: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Tumbling counts and sums by event type; late rows are dropped only from streams."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", lateness)
    w = F.window("at", length)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("w.start").cast("timestamp_ntz").cast("date").alias("day"), "event_type", "n", "total")
