"""Group profiles, frequencies and list aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import percent
from riskloom.operators.filters import nan_as_null
from riskloom.operators.reshape import to_variables
from riskloom.operators.selection import exact_quantiles


def group_means(df: DataFrame, group: str, columns: Sequence[str], target: str, digits: int = 2) -> DataFrame:
    """Means of ``columns`` and the target rate in % per group, rounded once; NaN counts as missing."""
    return (
        nan_as_null(df).groupBy(group)
        .agg(
            *[F.round(F.avg(F.col(c).cast("double")), digits).alias(c) for c in columns],
            F.round(F.avg(F.col(target).cast("double")) * 100, digits).alias("tasa_default_pct"),
        )
        .orderBy(group)
    )


def group_statistics(
    df: DataFrame, group: str, spread: str, centre: str, target: str, digits: int = 2
) -> DataFrame:
    """Mean / median / std of ``spread``, mean / median of ``centre``, rate and size per group.

    Medians come from rank selection, so a hot group is never held in one task.
    """
    df = nan_as_null(df)
    base = (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.round(F.avg(F.col(spread).cast("double")), digits).alias(f"{spread}_media"),
            F.round(F.stddev_samp(F.col(spread).cast("double")), digits).alias(f"{spread}_desvest"),
            F.round(F.avg(F.col(centre).cast("double")), digits).alias(f"{centre}_media"),
            F.round(F.avg(F.col(target).cast("double")) * 100, digits).alias("tasa_default_pct"),
            F.count(target).alias("tamano"),
        )
    )
    rows = to_variables(df, [spread, centre], [group])
    medians = exact_quantiles(rows, "value", [0.5], [group, "variable"], ["m"])
    wide = medians.groupBy(group).agg(
        *[
            F.round(F.max(F.when(F.col("variable") == c, F.col("m"))), digits).alias(f"{c}_mediana")
            for c in (spread, centre)
        ]
    )
    return base.join(wide, group, "left").orderBy(group)


def group_summary(df: DataFrame, group: str, value: Any, target: str, limit: str, age: str) -> DataFrame:
    """Size, rate, mean limit and mean age of one group."""
    return df.where(F.col(group) == F.lit(value)).agg(
        F.count("*").alias("clientes"),
        (F.avg(F.col(target).cast("double")) * 100).alias("tasa_default"),
        F.avg(F.col(limit).cast("double")).alias("limite_promedio"),
        F.avg(F.col(age).cast("double")).alias("edad_promedio"),
    )


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Rows per group in key order."""
    return df.groupBy(group).agg(F.count("*").alias("tamano")).orderBy(group)


def global_rate(df: DataFrame, target: str) -> DataFrame:
    """Share of the target in %."""
    return df.agg((F.avg(F.col(target).cast("double")) * 100).alias("tasa_default_global"))


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean of each column; NaN counts as missing."""
    return nan_as_null(df).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def value_frequency(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Count and % of non-null values, largest first, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("cantidad"))
    total = df.agg(F.count(column).alias("t")).scalar()
    return counts.withColumn("porcentaje", F.round(percent(F.col("cantidad"), total), digits)).orderBy(
        F.col("cantidad").desc(), F.col(column).asc()
    )


def two_way_counts(df: DataFrame, attribute: str, target: str) -> DataFrame:
    """Counts by attribute and target class."""
    return df.groupBy(attribute, target).agg(F.count("*").alias("cantidad"))


def members_by_entity(
    entities: DataFrame,
    entity_key: str,
    entity_name: str,
    memberships: DataFrame,
    member_key: str,
    members: DataFrame,
    member_name: str,
    separator: str = ", ",
) -> DataFrame:
    """Entities with the sorted list of the names they are linked to; none gives NULL.

    ``memberships`` has columns ``entity_key`` and ``member_key``. A pair counts
    once, so a list is never longer than ``members``.
    """
    pairs = memberships.select(entity_key, member_key).where(
        F.col(entity_key).isNotNull() & F.col(member_key).isNotNull()
    ).distinct()
    named = pairs.join(members.select(member_key, member_name), member_key)
    lists = named.groupBy(entity_key).agg(
        F.array_join(F.sort_array(F.collect_list(member_name)), separator).alias("miembros")
    )
    return entities.select(entity_key, entity_name).join(lists, entity_key, "left").orderBy(entity_name)
