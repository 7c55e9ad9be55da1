"""An append-only log of review decisions: revisions follow each other by number and by hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import Refusal

SCHEMA = "review string, revision long, author string, noted_at timestamp, payload string, before string, hash string"
GENESIS = "0" * 64


def _digest(review: str, revision: int, author: str, payload: str, before: str) -> str:
    return hashlib.sha256("\x1f".join([before, review, str(revision), author, payload]).encode()).hexdigest()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def append(spark: SparkSession, path: str, review: str, author: str, payload: str, revision: int | None = None) -> int:
    """Add the next revision of a review; returns its number.

    ``revision`` is the number that the writer expects: another one than the next is refused, so two
    writers that saw the same state do not both succeed unnoticed (``broken`` finds what slipped through).
    """
    try:
        last = read(spark, path).where(F.col("review") == review).orderBy(F.col("revision").desc()).limit(1).collect()
    except Exception as e:  # the first entry makes the log
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = []
    number = last[0]["revision"] + 1 if last else 1
    if revision is not None and revision != number:
        raise Refusal("invalid_option", f"revision {revision}; the next one is {number}", "revision")
    before = last[0]["hash"] if last else GENESIS
    row = [(review, number, author, payload, before, _digest(review, number, author, payload, before))]
    frame = spark.createDataFrame(row, "review string, revision long, author string, payload string, before string, hash string")
    frame.withColumn("noted_at", F.current_timestamp()).select("review", "revision", "author", "noted_at", "payload", "before", "hash").coalesce(1).write.mode("append").parquet(path)
    return number


def latest(log: DataFrame) -> DataFrame:
    """The last revision of every review."""
    return log.groupBy("review").agg(F.max_by(F.struct("revision", "author", "noted_at", "payload", "hash"), "revision").alias("row")).select("review", "row.*")


def broken(log: DataFrame) -> DataFrame:
    """Entries that do not follow from the one before: a number, a link or a digest that is not what it has to be."""
    w = Window.partitionBy("review").orderBy("revision", "hash")
    rows = log.withColumns({"wanted": F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)), "place": F.row_number().over(w)})
    own = F.sha2(F.concat_ws("\x1f", "before", "review", F.col("revision").cast("string"), "author", "payload"), 256)
    return rows.where((F.col("revision") != F.col("place")) | (F.col("before") != F.col("wanted")) | (F.col("hash") != own)).select("review", "revision", "author", "hash")
