"""Scalar expressions with a fixed meaning across the library."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bit_int(c: Column | str) -> Column:
    """A bit as 0/1."""
    return _col(c).cast("int")


def bit_text(c: Column | str) -> Column:
    """A bit as '0'/'1', never 'true'."""
    return _col(c).cast("int").cast("string")


def to_number(c: Column | str, kind: str = "double") -> Column:
    """Text to number; text that is not a number becomes NULL."""
    return F.trim(_col(c)).try_cast(kind)


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def round_half_even(c: Column | str, digits: int) -> Column:
    """Rounding as numpy does it (ties to the even digit)."""
    return F.bround(_col(c), digits)


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in %, NULL when ``whole`` is 0."""
    return F.try_divide(part * F.lit(100.0), whole)


def pages_to_kb(c: Column | str) -> Column:
    """8-KB pages to KB."""
    return _col(c) * 8


def kb_to_mb(c: Column | str) -> Column:
    """Whole MB of a size in KB."""
    return F.floor(_col(c) / F.lit(1024))


def qualified_name(schema: Column | str, table: Column | str) -> Column:
    """``schema.table``; NULL if either part is NULL."""
    return F.concat(_col(schema), F.lit("."), _col(table))


def row_label(*parts: Column | str, separator: str = " - ") -> Column:
    """Parts joined for display; NULL parts are left out."""
    return F.concat_ws(separator, *[_col(p).cast("string") for p in parts])


def label_id(label: Column | str, separator: str = " - ") -> Column:
    """The integer in front of the first separator of a row label."""
    return F.split_part(_col(label), F.lit(separator), F.lit(1)).cast("int")


def short_date(c: Column | str) -> Column:
    """The first 19 characters of a date text: date and time to the second."""
    return F.substring(_col(c), 1, 19)


def is_query(c: Column | str) -> Column:
    """Whether a statement starts with a reading keyword."""
    text = F.upper(F.trim(_col(c)))
    return F.startswith(text, F.lit("SELECT")) | F.startswith(text, F.lit("WITH"))


def minute_text(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm")


def compact_time(c: Column | str) -> Column:
    """A time as part of a file name."""
    return F.date_format(_col(c), "yyyyMMdd_HHmmss")


def label_of(c: Column | str, labels: Mapping[int, str]) -> Column:
    """Label by value; an unlisted value gives NULL."""
    value = _col(c)
    out = F.lit(None).cast("string")
    for key, text in labels.items():
        out = F.when(value == F.lit(key), F.lit(text)).otherwise(out)
    return out


# --- fixed values: class and risk labels ---------------------------------------
CLASS_LABELS = {0: "No Default", 1: "Default"}
HIGH_RISK = "ALTO RIESGO DE DEFAULT"
LOW_RISK = "BAJO RIESGO"
# -------------------------------------------------------------------------------


def class_label(c: Column | str) -> Column:
    return label_of(c, CLASS_LABELS)


def risk_label(prediction: Column | str) -> Column:
    return F.when(_col(prediction) == 1, HIGH_RISK).otherwise(LOW_RISK)
