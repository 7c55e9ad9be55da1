"""Running the snapshot stream over a folder on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rundelta.functions.storage import shared_folder
from rundelta.streaming.snapshot import run_available


def folder_of(spark: SparkSession) -> str:
    """A new folder for a stream's files and state."""
    return shared_folder(spark, "stream")


def stream_of(spark: SparkSession, observations: DataFrame, folder: str) -> DataFrame:
    """Write observations as files of a stream's source and fold them."""
    observations.repartition(4, "origin_period").write.parquet(f"{folder}/in")
    return run_available(spark, f"{folder}/in", observations.schema, f"{folder}/state")
