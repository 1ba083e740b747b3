"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of narrow tables that are broadcast at most.
ROWS = 200_000


def small(df: DataFrame, rows: int = ROWS) -> bool:
    """Whether df has so many rows at most; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df marked for broadcast when it is small; otherwise the join shuffles."""
    return F.broadcast(df) if small(df, rows) else df
