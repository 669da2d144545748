"""Quantile sketches that are kept for each batch and merged: approximate ranks without reading the rows again.

The exact way (:mod:`riskloom.operators.selection`) stays the default everywhere. A sketch answers at once for any union
of batches: its value for a probability p has a rank within ``rank_error`` of p, whatever the order of merging.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.filters import nan_as_null

#: Size of a sketch: about this many values are kept, whatever the rows.
SKETCH_SIZE = 4_096


def rank_error(size: int = SKETCH_SIZE) -> float:
    """The rank error of one answer that 99 of 100 sketches of this size stay below."""
    return 2.296 / size**0.9021


def column_sketches(df: DataFrame, columns: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """(columna, filas, resumen): a sketch of each column's values (no NULL, no NaN), all in one wide aggregate."""
    facts = [
        F.struct(
            F.lit(c).alias("columna"),
            F.count(c).alias("filas"),
            F.kll_sketch_agg_double(F.col(c).cast("double"), size).alias("resumen"),
        )
        for c in columns
    ]
    row = nan_as_null(df.select(*columns)).agg(*[f.alias(c) for f, c in zip(facts, columns, strict=True)])
    return row.select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def append_sketches(sketches: DataFrame, path: str, batch: int) -> None:
    """Keep the sketches of one batch; writing a batch again replaces it."""
    sketches.coalesce(1).write.mode("overwrite").parquet(f"{path}/lote={batch}")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(sketches: DataFrame) -> DataFrame:
    """One sketch for each column from those of any batches."""
    return sketches.groupBy("columna").agg(
        F.sum("filas").alias("filas"), F.kll_merge_agg_double("resumen").alias("resumen")
    )


def quantiles(sketches: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(columna, filas, p, valor): NULL for a column without values."""

    def at(p: float) -> Column:
        value = F.when(F.col("filas") > 0, F.kll_sketch_get_quantile_double("resumen", F.lit(float(p))))
        return F.struct(F.lit(float(p)).alias("p"), value.alias("valor"))

    rows = sketches.withColumn("r", F.explode(F.array(*map(at, probabilities))))
    return rows.select("columna", "filas", "r.p", "r.valor")
