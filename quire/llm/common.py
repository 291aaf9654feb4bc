"""Shared plumbing of the training-data operators: shared folder, cut points, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.shared import materialize, scratch, shared_dir

__all__ = ["BROADCAST_ROWS", "join_small", "materialize", "scratch", "shared_dir", "spread"]

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with ``right`` broadcast if its counted rows are few, by shuffle otherwise.

    ``right`` should be a materialized table, as it is counted here unless ``rows`` is given.
    """
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("shuffle_merge"), on, how)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by ``cols`` over the session's shuffle partitions, without coalescing."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
