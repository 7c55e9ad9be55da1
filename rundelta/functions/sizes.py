"""Broadcast hints behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a broadcast may hold at most.
BROADCAST_BYTES = 24 * 1024 * 1024


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """With a broadcast hint if the counted rows fit, else as it is.  Runs a job."""
    return F.broadcast(df) if df.limit(BROADCAST_BYTES // row_bytes + 1).count() * row_bytes <= BROADCAST_BYTES else df
