"""Tables and views: external databases, catalog listings, previews, ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.star import client_detail, migration_summary, ml_dataset
from riskloom.schemas import CreditStar


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table, view or ``(select …) alias`` of an external database.

    With a partition column the read is split into ranges that executors fetch
    in parallel. Credentials come from the caller through ``properties``.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **dict(properties or {}))
    if partition_column is not None:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partitioned read needs lower, upper and partitions")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def register_views(star: CreditStar, staging: DataFrame | None = None) -> None:
    """The star tables, catalogs and views under their names, for ``spark.sql``."""
    star.dim_cliente.createOrReplaceTempView("dim_cliente")
    star.riesgo_crediticio.createOrReplaceTempView("riesgo_crediticio")
    star.historial_pagos.createOrReplaceTempView("historial_pagos")
    for name in ["dim_sexo", "dim_educacion", "dim_estado_civil", "dim_tiempo_mes", "dim_estatus_pago"]:
        star.catalog(name).createOrReplaceTempView(name)
    ml_dataset(star).createOrReplaceTempView("vw_ml_dataset")
    client_detail(star).createOrReplaceTempView("vw_cliente_detallado")
    if staging is not None:
        staging.createOrReplaceTempView("staging_credit_cards")
        migration_summary(staging, star).createOrReplaceTempView("vw_resumen_migracion")


def read_view(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def preview(spark: SparkSession, table: str, n: int = 50) -> DataFrame:
    """Any ``n`` rows of a table or view, 10 to 500."""
    if not 10 <= n <= 500:
        raise ValueError("n must be between 10 and 500")
    return spark.table(table).limit(n)


_CATALYST = "org.apache.spark.sql.catalyst.plans.logical."
#: plans that write, change the session or start a program
_REFUSED = ("Command", "ParsedStatement", "ScriptTransformation")


def _reads_only(spark: SparkSession, text: str) -> bool:
    """Whether a statement, parsed but not run, is a query through and through."""
    jvm = spark.sparkContext._jvm
    refused = [jvm.java.lang.Class.forName(_CATALYST + name) for name in _REFUSED]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while todo:
        plan = todo.pop()
        if any(kind.isInstance(plan) for kind in refused):
            return False
        for group in (plan.children(), plan.innerChildren()):
            todo += [group.apply(i) for i in range(group.size())]
    return True


def run_query(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a reading statement. Commands, inserts and more than one statement are refused before anything runs."""
    if not _reads_only(spark, text):
        raise ValueError("only reading statements are allowed")
    return spark.sql(text)


#: Procedures of the credit database as SQL table functions over the views of ``register_views``. ``EXEC name args``
#: becomes ``SELECT * FROM name(args)``, which also joins and filters. Parameters reach the scans as literals.
PROCEDURES = {
    "lote_siguiente": (
        "n INT",
        """SELECT * EXCEPT (posicion) FROM (
             SELECT *, row_number() OVER (ORDER BY ID NULLS FIRST) AS posicion FROM staging_credit_cards)
           WHERE posicion <= n AND n BETWEEN 1 AND 500""",
    ),
    "historial_cliente": (
        "cliente BIGINT",
        """SELECT h.id_cliente, m.mes_referencia, e.descripcion_estatus AS estado_de_pago,
             h.monto_estado_cuenta, h.monto_pago_anterior
           FROM historial_pagos h JOIN dim_tiempo_mes m ON m.id_mes = h.id_mes
           JOIN dim_estatus_pago e ON e.id_estatus = h.id_estatus_pago WHERE h.id_cliente = cliente""",
    ),
    "resumen_migracion": ("", "SELECT * FROM vw_resumen_migracion"),
}


def register_procedures(spark: SparkSession) -> None:
    """Temporary table functions for :func:`run_query`; call it after :func:`register_views` with staging rows.

    ``lote_siguiente(n)`` is the next batch by id (1 to 500 rows; none for other n), ``historial_cliente(cliente)`` the
    months of a client, ``resumen_migracion()`` the row counts. The batch keeps n rows a task before its only gather.
    """
    for name, (parameters, body) in PROCEDURES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {body}")


def list_tables(
    spark: SparkSession, kind: str | None = None, exclude: tuple[str, ...] = (), schema: str | None = None
) -> DataFrame:
    """Registered tables and views (schema, name, type), filtered and sorted by name."""
    rows = [
        (".".join(t.namespace) if t.namespace else "", t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE")
        for t in spark.catalog.listTables(schema)
    ]
    tables = spark.createDataFrame(rows, "esquema string, tabla string, tipo string")
    if kind:
        tables = tables.where(F.col("tipo") == kind)
    if exclude:
        tables = tables.where(~F.col("tabla").isin(*exclude))
    return tables.orderBy("esquema", "tabla")


def table_exists(spark: SparkSession, name: str) -> int:
    return int(spark.catalog.tableExists(name))


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, files and bytes per file-backed table, most rows first.

    Grouping by file metadata reads no data column. Sizes are those of the
    distinct files behind the table.
    """
    parts = [
        df.groupBy(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
        ).agg(F.count("*").alias("n")).select(F.lit(name).alias("tabla"), "path", "size", "n")
        for name, df in tables.items()
    ]
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    return (
        files.groupBy("tabla")
        .agg(F.sum("n").alias("filas"), F.count("*").alias("archivos"), F.sum("size").alias("bytes"))
        .orderBy(F.col("filas").desc(), "tabla")
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """Number of tables, total rows, MB and whole mean rows per table."""
    return inventory.agg(
        F.count("*").alias("total_tablas"),
        F.coalesce(F.sum("filas"), F.lit(0)).alias("total_filas"),
        (F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(1024.0 * 1024.0)).alias("total_mb"),
        F.coalesce(F.floor(F.try_divide(F.sum("filas"), F.count("*"))), F.lit(0)).alias("promedio_filas"),
    )


def with_row_counts(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """A listing of tables (schema, name, type) with the rows of each."""
    out = []
    for row in listed.collect():  # one for each table
        name = f"`{row['esquema']}`.`{row['tabla']}`" if row["esquema"] else f"`{row['tabla']}`"
        counted = spark.table(name).agg(F.count("*").alias("filas"))
        out.append(counted.select(*[F.lit(row[c]).alias(c) for c in ("esquema", "tabla", "tipo")], "filas"))
    empty = spark.createDataFrame([], "esquema string, tabla string, tipo string, filas long")
    return reduce(DataFrame.unionByName, out, empty)
