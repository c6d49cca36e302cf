"""Broadcast of a side whose size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a catalog that are certainly small enough to send to every executor.
MAX_BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged.

    The check counts no more than ``max_rows + 1`` rows of the frame.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
