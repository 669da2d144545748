"""The experiment log: nested JSON documents, one per model run."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import short_date
from riskloom.operators.filters import when_given
from riskloom.operators.selection import top_rows
from riskloom.schemas import EXPERIMENT_SCHEMA

ABSENT = "N/A"


def append_experiment(
    spark: SparkSession, path: str, date: str, algorithm: str, parameters: Mapping[str, Any], metrics: Mapping[str, Any]
) -> None:
    """Append one run as a nested JSON document; numbers stay numbers."""
    document = {
        "fecha": date, "algoritmo": algorithm, "hiperparametros": dict(parameters), "metricas": dict(metrics)
    }
    line = spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string")
    line.coalesce(1).write.mode("append").text(path)


def append_documents(documents: DataFrame, path: str) -> None:
    """Append a frame of documents as JSON lines."""
    documents.write.mode("append").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a folder; absent fields are NULL."""
    return spark.read.schema(EXPERIMENT_SCHEMA).json(path)


def parse_documents(df: DataFrame, column: str) -> DataFrame:
    """Documents held as JSON text in a column."""
    return df.select(F.from_json(column, EXPERIMENT_SCHEMA).alias("d")).select("d.*")


def _field(group: str, *names: str) -> Column:
    """The first named entry of a map that is there."""
    return F.coalesce(*[F.col(group).getItem(n) for n in names])


def flatten_documents(documents: DataFrame) -> DataFrame:
    """One row per run. Which field is shown depends on the algorithm; absent is ``N/A``.

    The numeric columns hold the same values with NULL for absent.
    """
    size = _field("hiperparametros", "n_clusters", "n_estimators")
    quality = _field("metricas", "silhouette_score", "accuracy")
    spread = _field("metricas", "inertia", "f1_score")
    rows = _field("metricas", "total_registros_procesados")
    shown = {"tamano_modelo": size, "calidad": quality, "inercia_f1": spread, "registros": rows}
    return documents.select(
        short_date(F.coalesce("fecha", F.lit(ABSENT))).alias("fecha"),
        F.coalesce("algoritmo", F.lit(ABSENT)).alias("algoritmo"),
        *[F.coalesce(c, F.lit(ABSENT)).alias(name) for name, c in shown.items()],
        size.try_cast("int").alias("tamano_modelo_num"),
        quality.try_cast("double").alias("calidad_num"),
        spread.try_cast("double").alias("inercia_f1_num"),
        rows.try_cast("bigint").alias("registros_num"),
    )


def explode_parameters(documents: DataFrame) -> DataFrame:
    """(fecha, algoritmo, parametro, valor), one row per hyper-parameter."""
    return documents.select(
        "fecha", "algoritmo", F.explode("hiperparametros").alias("parametro", "valor")
    )


def latest_documents(documents: DataFrame, algorithm: str | None = None, n: int = 10) -> DataFrame:
    """The newest ``n`` documents by date text, of one algorithm if given."""
    chosen = when_given(documents, "algoritmo", algorithm, everything="Todos")
    order = [F.col("fecha").desc_nulls_last(), F.col("algoritmo").asc(), F.to_json("hiperparametros").asc()]
    return top_rows(chosen, order, n)


def count_by_algorithm(documents: DataFrame) -> DataFrame:
    """Runs in total and per known algorithm."""
    return documents.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("algoritmo") == "K-Means").alias("k_means"),
        F.count_if(F.col("algoritmo") == "Random Forest").alias("random_forest"),
    )


def count_by_collection(collections: Mapping[str, DataFrame]) -> DataFrame:
    """Documents per collection."""
    parts = [
        df.agg(F.count("*").alias("documentos")).select(F.lit(name).alias("coleccion"), "documentos")
        for name, df in collections.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- documents whose fields differ: one VARIANT column keeps every field with its own type --------------------------


def open_documents(texts: DataFrame, column: str, output: str = "documento") -> DataFrame:
    """Documents held as JSON text as a VARIANT column in its place; text that is no JSON becomes NULL."""
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, F.try_parse_json(column).alias(output))


def append_open_documents(documents: DataFrame, path: str) -> None:
    """Append documents with a VARIANT column; no schema is agreed on, so new fields need no change of the table."""
    documents.write.mode("append").parquet(path)


def read_open_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(document: str, *paths: str, kind: str = "string", default: Any = None) -> Column:
    """The value at the first of the paths (``$.group.name``) that holds one of that kind, else the default."""
    found = [F.try_variant_get(document, path, kind) for path in paths]
    return F.coalesce(*found, F.lit(default).cast(kind))


def document_fields(documents: DataFrame, column: str = "documento") -> DataFrame:
    """(campo, documentos, tipo): every top-level field of the collection, in how many documents, and its merged type."""
    fields = documents.where(F.col(column).isNotNull()).lateralJoin(
        documents.sparkSession.tvf.variant_explode(F.col(column).outer())
    )
    return fields.groupBy(F.col("key").alias("campo")).agg(
        F.count("*").alias("documentos"), F.schema_of_variant_agg("value").alias("tipo")
    )
