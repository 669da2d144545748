"""Wide-to-long, long-to-wide, cross tables and counts side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.schemas import MONTH_COLUMNS


def unpivot_history(staging: DataFrame, key: str = "ID") -> DataFrame:
    """Six history rows per client; months with NULL amounts stay."""
    args = ", ".join(f"{month}, {', '.join(names)}" for month, names in MONTH_COLUMNS)
    return staging.select(
        F.col(key).alias("id_cliente"),
        F.expr(
            f"stack({len(MONTH_COLUMNS)}, {args}) "
            "as (id_mes, id_estatus_pago, monto_estado_cuenta, monto_pago_anterior)"
        ),
    )


def pivot_history(history: DataFrame) -> DataFrame:
    """One row per client: the largest status, bill and payment of each month.

    The maximum is taken per measure, so two rows for one month may mix. A
    month without rows is NULL. One hash aggregate, combined map-side.
    """
    measures = ["id_estatus_pago", "monto_estado_cuenta", "monto_pago_anterior"]
    cells = [
        F.max(F.when(F.col("id_mes") == month, F.col(measure))).alias(names[i])
        for i, measure in enumerate(measures)
        for month, names in MONTH_COLUMNS
    ]
    return history.groupBy("id_cliente").agg(*cells)


def to_variables(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as (``by``, variable, value) rows, value as double."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([F.col(c) for c in by], list(columns), "variable", "value")


def cross_table(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``row`` by the given ``column`` values, missing cells 0."""
    counts = [
        F.count_if(F.col(column) == F.lit(v)).alias(f"{column}_{v}") for v in values
    ]
    return df.groupBy(row).agg(*counts)


def majority_class(df: DataFrame, group: str, label: str) -> DataFrame:
    """The most frequent label of each group; a tie goes to the smaller label.

    Counts by (group, label) are combined map-side, so a hot group costs one
    row per task.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("__c"))
    return counts.groupBy(group).agg(F.max_by(label, F.struct(F.col("__c"), -F.col(label))).alias("majority"))


def counts_side_by_side(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``count(*)`` of several tables in one row, without a cross join."""
    parts = [
        df.agg(F.count("*").alias("c")).select(F.lit(name).alias("name"), "c") for name, df in tables.items()
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.agg(*[F.max(F.when(F.col("name") == name, F.col("c"))).alias(name) for name in tables])
