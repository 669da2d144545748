"""Feature columns: scaling, weights, hold-out slices, filling holes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.filters import nan_as_null
from riskloom.operators.selection import order_statistics
from riskloom.sizing import join_checked


def assembler(names: Sequence[str], output: str = "raw_features") -> VectorAssembler:
    """Columns to a vector, by name and in the given order."""
    return VectorAssembler(inputCols=list(names), outputCol=output, handleInvalid="error")


def scaler(source: str = "raw_features", output: str = "features") -> StandardScaler:
    """Zero mean and unit (sample) deviation."""
    return StandardScaler(inputCol=source, outputCol=output, withMean=True, withStd=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame in memory (spilling to disk) while an iterative fit reads it."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns as z-scores with the population deviation; a constant column becomes 0.

    ``fit_on`` supplies the statistics (the training rows); by default ``df``.
    They are one row, so the scaling itself is a projection. NULLs stay,
    and NaN becomes NULL.
    """
    parts = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        parts += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
    df = nan_as_null(df)
    facts = (df if fit_on is None else nan_as_null(fit_on)).agg(*parts).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, spread = facts[f"m{i}"], facts[f"s{i}"]
        centred = F.col(c).cast("double") - F.lit(mean)
        scaled[c] = centred / F.lit(spread) if spread else F.when(centred.isNotNull(), 0.0)
    return df.withColumns(scaled)


@dataclass(frozen=True)
class Scaling:
    """Mean and deviation of each part of a vector."""

    mean: tuple[float, ...]
    deviation: tuple[float, ...]


def vector_scaling(df: DataFrame, column: str) -> Scaling:
    """The population scaling of an array column, from one vector summary."""
    source = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    summary = source.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    facts = summary.select("s.mean", "s.variance", "s.count").first()
    rows = facts["count"]
    return Scaling(
        tuple(facts["mean"].toArray().tolist()),
        tuple(math.sqrt(v * (rows - 1) / rows) for v in facts["variance"].toArray().tolist()),
    )


def scale_array(df: DataFrame, column: str, scaling: Scaling, output: str = "features") -> DataFrame:
    """An array of numbers as a vector of z-scores; a constant part becomes 0."""
    point = F.col(column).cast("array<double>")
    mean = F.array(*map(F.lit, scaling.mean))
    inverse = F.array(*[F.lit(1.0 / d if d else 0.0) for d in scaling.deviation])
    scaled = F.zip_with(F.zip_with(point, mean, lambda x, m: x - m), inverse, lambda x, w: x * w)
    return df.withColumn(output, array_to_vector(scaled))


def standardize_array(
    df: DataFrame, column: str, output: str = "features", fit_on: DataFrame | None = None
) -> DataFrame:
    """An array of numbers as a vector of z-scores (population deviation, constant parts 0).

    For wide inputs: one vector summary instead of two aggregates per column.
    """
    return scale_array(df, column, vector_scaling(df if fit_on is None else fit_on, column), output)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (classes × n_class)`` per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_clase"))
    whole = counts.agg(F.struct(F.sum("n_clase").alias("n"), F.count("*").alias("k")).alias("w")).scalar()
    return counts.withColumn(
        "peso", whole.getField("n").cast("double") / (whole.getField("k") * F.col("n_clase")).cast("double")
    )


def with_class_weights(df: DataFrame, label: str, output: str = "peso") -> DataFrame:
    """Rows with their class weight."""
    weights = class_weights(df, label).select(label, F.col("peso").alias(output))
    return join_checked(df, weights, [label])


def slices(
    df: DataFrame, key: str, label: str, fractions: Sequence[float], seed: int = 42, output: str = "slice"
) -> DataFrame:
    """Cut each class at the given fractions of a repeatable order.

    The order is a hash of the (unique) key, so it does not depend on
    partitioning. The slice edges are exact ranks in that order, found without
    sorting a class in one task: a class may hold most of the rows.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    targets = {
        f"cut{i}": (f, F.floor(F.col("n") * F.lit(float(f)) + F.lit(0.5)) - 1) for i, f in enumerate(fractions)
    }
    cuts = order_statistics(hashed, "__h", targets, [label]).drop("n")
    placed = join_checked(hashed, cuts, [label], "left")
    index = sum((F.coalesce(F.col("__h") > F.col(c), F.lit(True)).cast("int") for c in targets), F.lit(0))
    return placed.withColumn(output, index).drop("__h", *targets)


def stratified_holdout(
    df: DataFrame, key: str, label: str, fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): ``round(fraction · n)`` test rows of each class."""
    cut = slices(df, key, label, [fraction], seed)
    return cut.where("slice = 1").drop("slice"), cut.where("slice = 0").drop("slice")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Rows with an integer ``fold`` column, classes spread evenly."""
    return slices(df, key, label, [i / folds for i in range(1, folds)], seed, "fold")


def fill_with_means(df: DataFrame, columns: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """NULL inputs replaced by the column means of ``reference`` (default ``df``).

    Columns that ``df`` lacks are added, holding the mean.
    """
    source = df if reference is None else reference
    means = source.agg(
        F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).alias("m")
    ).scalar()
    present = set(df.columns)
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), means.getField(c)) if c in present else means.getField(c)
            for c in columns
        }
    )
