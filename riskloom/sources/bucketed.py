"""The star stored in buckets by client, so that pivots and joins by client need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.schemas import CreditStar
from riskloom.session import scratch_path

KEY = "id_cliente"


def _bucket(buckets: int) -> Column:
    """The bucket that Spark itself gives to a client."""
    return F.pmod(F.hash(KEY), F.lit(buckets))


def _store(df: DataFrame, name: str, path: str, buckets: int, files: int) -> DataFrame:
    if files > 1:  # rows of one bucket are dealt by their content: a retried task deals them again as before
        dealt = df.repartition(buckets * files, _bucket(buckets), F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    else:
        dealt = df.repartition(buckets, KEY)
    dealt.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def store_star(
    star: CreditStar, schema: str, buckets: int, *, history_files: int = 4, root: str | None = None
) -> CreditStar:
    """Write the three tables into ``schema`` in ``buckets`` by client and return them as read back.

    The shuffle by client is paid once, here; afterwards every task of a pivot or join by client reads the same bucket
    of all tables. A bucket of the history is written as ``history_files`` files by different tasks, so that a client
    with a third of all rows is not written by one. Such a client is read by one task all the same, which adds its rows
    up as they come. NULL clients share a bucket and join with nothing. Each call writes to a fresh folder (under
    ``root``, by default the shared one): frames of an earlier call keep their rows.
    """
    if buckets < 1 or history_files < 1:
        raise ValueError("buckets and files are at least 1")
    spark = star.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    path = root or scratch_path(spark, schema)

    def stored(df: DataFrame, name: str, files: int = 1) -> DataFrame:
        return _store(df, f"`{schema}`.`{name}`", f"{path}/{name}", buckets, files)

    return CreditStar(
        stored(star.dim_cliente, "dim_cliente"),
        stored(star.riesgo_crediticio, "riesgo_crediticio"),
        stored(star.historial_pagos, "historial_pagos", history_files),
    )
