"""Folds and bounded samples of rows by their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def remainder(id_col: str, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``: the fold of a row."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def hashed_below(id_col: str, share: Column) -> Column:
    """Whether a row is in the given share (0 to 1) of all rows, by the hash of its id."""
    return F.pmod(F.xxhash64(id_col), F.lit(_RANGE)) < share * _RANGE


def bounded_sample(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """``limit`` rows by the hash of their id; all if there are no more.

    The rows are counted first, so that only about a quarter more than ``limit`` leave their tasks.
    """
    total = rows.count()
    if total > limit:
        rows = rows.where(hashed_below(id_col, F.lit(1.25 * limit / total)))
    return rows.orderBy(F.pmod(F.xxhash64(id_col), F.lit(_RANGE)), id_col).limit(limit)
