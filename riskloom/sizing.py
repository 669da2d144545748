"""Broadcast a side only after its row count has been checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LOCAL_ROWS = 10_000


def keep_local(df: DataFrame, limit: int = MAX_LOCAL_ROWS) -> tuple[DataFrame, bool]:
    """Return ``df`` as a local table when it has at most ``limit`` rows.

    At most ``limit + 1`` rows ever reach the driver. A larger frame comes back
    unchanged with ``False``; the caller then joins it with a shuffle.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def join_checked(
    big: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner", limit: int = MAX_LOCAL_ROWS
) -> DataFrame:
    """Join, broadcasting ``side`` only if it is within ``limit`` rows."""
    side, local = keep_local(side, limit)
    return big.join(F.broadcast(side) if local else side, list(on), how)
