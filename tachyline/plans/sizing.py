"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``side`` holds at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows. Beyond the bound the frame comes
    back unhinted, and the join shuffles both sides (adaptive execution then splits
    a skewed partition). Meant for dimension tables, not for derived results.
    """
    if side.isStreaming:
        return side
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side
