"""CSV in and out. Headers are recognised by content, so every file of a folder may carry them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import STAGING_SCHEMA


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _data_lines(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Trimmed cells of all lines but headers; an empty cell is NULL.

    A header is a line none of whose cells is a number; every other line is
    data. A line with too few or too many cells is an error.
    """
    raw = spark.read.schema(_text_schema(names)).option("mode", "FAILFAST").csv(path, header=False)
    cells = raw.select(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names])
    numbers = [F.col(f"`{n}`").try_cast("double").isNotNull() for n in names]
    return cells.where(reduce(lambda x, y: x | y, numbers))


def read_staging_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide client CSV as typed staging rows, headers left out.

    Empty cells stay NULL, also the id and the target; text in a number column
    is an error.
    """
    rows = _data_lines(spark, path, STAGING_SCHEMA.names)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STAGING_SCHEMA.fields])


def read_numeric_csv(spark: SparkSession, path: str, names: Sequence[str] = tuple(STAGING_SCHEMA.names)) -> DataFrame:
    """The same CSV with every column a number (text is an error) and incomplete rows dropped."""
    rows = _data_lines(spark, path, names)
    return rows.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names]).na.drop("any")


def read_sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose names are on the second line if that line holds a known name, else on the first.

    Only two lines reach the driver. Names are stripped; columns are numbers,
    NULL where a cell is empty.
    """
    lines = [row["value"] for row in spark.read.text(path).limit(2).collect()]
    second = [c.strip() for c in lines[1].split(",")] if len(lines) > 1 else []
    names = second if {"ID", "LIMIT_BAL"} & set(second) else [c.strip() for c in lines[0].split(",")]
    rows = _data_lines(spark, path, names)
    return rows.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names])


def write_features(df: DataFrame, path: str, vector: str, names: Sequence[str], label: str | None = None) -> None:
    """A feature vector (and label) as named CSV columns."""
    cells = vector_to_array(F.col(vector))
    columns = [cells[i].alias(name) for i, name in enumerate(names)]
    if label:
        columns.append(F.col(label))
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)



def write_training_files(
    train: DataFrame, test: DataFrame, root: str, vector: str, names: Sequence[str], label: str, key: str
) -> None:
    """Scaled features and labels of the training and hold-out rows as four CSV folders, each with the rows' key."""
    for part, rows in (("train", train), ("test", test)):
        write_features(rows, f"{root}/X_{part}_scaled", vector, names, key)
        rows.select(key, label).write.mode("errorifexists").option("header", True).csv(f"{root}/y_{part}")
