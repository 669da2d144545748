"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE (coalescing, skew joins) on and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse.

    Both are shared by the driver and all executors, so a lost executor loses
    nothing that was written here. Machine-local folders are never used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/riskloom-scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`scratch_path` placed, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over; it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Intermediate tables of one run, written as Parquet and dropped by name when used up."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = scratch_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, f"{self.root}/{name}")
