"""The credit star schema, logs and feature tables, derived from the given tables.

Orders stand for clients, line items for monthly history (line 7 is a month the
catalog does not know), the order status for the target, events for the change
log, the job history and the experiment documents. ``*_SQL`` holds the same
rules as common table expressions for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.reshape import pivot_history
from riskloom.operators.star import ml_dataset
from riskloom.schemas import (
    BILL_COLUMNS,
    EDUCATION_ROWS,
    MARITAL_ROWS,
    MONEY,
    MONTH_COLUMNS,
    MONTH_ROWS,
    PAID_COLUMNS,
    PAY_COLUMNS,
    SEX_ROWS,
    STATUS_ROWS,
    TARGET_COLUMN,
    CreditStar,
)
from riskloom.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _client_columns() -> list[Column]:
    return [
        F.col("o_orderkey").alias("id_cliente"),
        (F.col("o_custkey") % 2 + 1).cast("int").alias("id_sexo"),
        (F.col("o_custkey") % 7).cast("int").alias("id_educacion"),
        (F.col("o_orderkey") % 4).cast("int").alias("id_estado_civil"),
        (F.col("o_custkey") % 59 + 21).cast("smallint").alias("edad"),
        F.col("o_totalprice").cast(MONEY).alias("limite_credito"),
    ]


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_client_columns())


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status P have no target yet."""
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderstatus <> 'P'")
        .select(
            F.col("o_orderkey").alias("id_cliente"),
            (F.col("o_orderstatus") == "F").cast("int").alias("incumplimiento_proximo_mes"),
        )
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast("decimal(4,2)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id_cliente"),
        F.col("l_linenumber").alias("id_mes"),
        (F.col("l_quantity").cast("int") % 12 - 2).alias("id_estatus_pago"),
        F.col("l_extendedprice").cast(MONEY).alias("monto_estado_cuenta"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 7 != 0, paid.cast(MONEY)).alias("monto_pago_anterior"),
    )


def star(spark: SparkSession, sf_dir: str) -> CreditStar:
    return CreditStar(clients(spark, sf_dir), targets(spark, sf_dir), history(spark, sf_dir))


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table: one row per order, months without lines have status 0 and no amounts."""
    label = (F.col("o_orderstatus") == "F").cast("int").alias(TARGET_COLUMN)
    people = table(spark, sf_dir, "orders").select(*_client_columns(), label).select(
        F.col("id_cliente").alias("ID"),
        F.col("limite_credito").alias("LIMIT_BAL"),
        F.col("id_sexo").alias("SEX"),
        F.col("id_educacion").alias("EDUCATION"),
        F.col("id_estado_civil").alias("MARRIAGE"),
        F.col("edad").cast("int").alias("AGE"),
        TARGET_COLUMN,
    )
    wide = pivot_history(history(spark, sf_dir)).withColumnRenamed("id_cliente", "ID")
    return (
        people.join(wide, "ID", "left")
        .select(
            "ID", "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in PAY_COLUMNS],
            *BILL_COLUMNS,
            *PAID_COLUMNS,
            TARGET_COLUMN,
        )
    )


def stored_dataset(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the ML dataset as a written table, for statistics that read them several times."""
    return materialize(ml_dataset(star(spark, sf_dir)).select(*columns), "dataset")


def loaded_star(spark: SparkSession, sf_dir: str) -> CreditStar:
    """The star as it stands before a batch: every third client is loaded already."""
    whole = star(spark, sf_dir)
    return CreditStar(
        whole.dim_cliente.where("id_cliente % 3 = 0"),
        whole.riesgo_crediticio.where("id_cliente % 3 = 0"),
        whole.historial_pagos.where("id_cliente % 3 = 0"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    operation = F.when(kind.isin("signup", "view"), "I").when(kind.isin("purchase", "click"), "U").otherwise("D")
    bit = (F.get_json_object("props", "$.k").cast("int") % 2).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id_auditoria"),
        F.lit("riesgo_crediticio").alias("tabla_afectada"),
        operation.alias("operacion"),
        F.col("user_id").alias("id_registro_afectado"),
        F.concat(F.lit("usuario_"), F.col("user_id")).alias("usuario"),
        F.col("ts").alias("fecha_cambio"),
        F.when(operation != "I", bit).alias("datos_antes"),
        F.when(operation != "D", bit).alias("datos_despues"),
    )


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("backup_type"),
        F.concat(F.lit("/respaldo/"), F.col("event_type"), F.lit("/"), F.col("event_id")).alias("backup_path"),
        F.col("ts").alias("backup_date"),
        F.when(F.col("event_id") % 7 != 0, F.col("value").cast("decimal(10,2)")).alias("file_size_mb"),
        F.when(F.col("event_type") == "error", "Fallido").otherwise("Completado").alias("status"),
        F.concat(F.lit("usuario_"), F.col("user_id")).alias("usuario"),
        F.lit(None).cast("string").alias("notas"),
    )


def job_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schedule per user and event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(F.min("ts").alias("last_run"), F.max("ts").alias("next_run"), F.min("event_id").alias("id"))
        .select(
            "id",
            F.concat(F.lit("plan_"), F.col("user_id")).alias("schedule_name"),
            F.col("event_type").alias("backup_type"),
            F.lit("Diario").alias("frequency"),
            F.date_format("last_run", "HH:mm").alias("time_of_day"),
            (F.col("user_id") % 2).cast("int").alias("enabled"),
            "last_run",
            "next_run",
        )
    )


def experiment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per event; the fields depend on the event type."""
    k = F.get_json_object("props", "$.k")
    date = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    amount = F.col("value").cast("decimal(10,2)").cast("string")

    def doc(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    number = F.col("event_id").cast("string")
    k_means = doc(
        '{"fecha":"', date, '","algoritmo":"K-Means","hiperparametros":{"n_clusters":"', k,
        '","random_state":"42"},"metricas":{"silhouette_score":"0.', k, '","inertia":"', amount,
        '","total_registros_procesados":"', number, '"}}',
    )
    forest = doc(
        '{"fecha":"', date, '","algoritmo":"Random Forest","hiperparametros":{"n_estimators":"', k,
        '"},"metricas":{"accuracy":"0.', k, '","f1_score":"', amount, '"}}',
    )
    bare = doc('{"fecha":"', date, '"}')
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind.isin("click", "view"), k_means).when(kind == "purchase", forest).when(kind == "signup", bare)
        .otherwise(F.lit("{}")).alias("documento")
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth from ``toxic``, a probability from the document length."""
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(4000.0))
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
        .select("doc_id", F.col("toxic").alias("real"), F.col("quality").alias("calidad"), "n_chars",
                score.alias("probabilidad"), (score >= 0.35).cast("int").alias("predicho"))
    )


def customers_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with every seventh balance and every fifth nation missing."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        "c_mktsegment",
    )


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    cells = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )
    return f"{name}({columns}) AS (VALUES {cells})"


def _pivot_cells() -> str:
    out = []
    for measure, position in [("id_estatus_pago", 0), ("monto_estado_cuenta", 1), ("monto_pago_anterior", 2)]:
        out += [f"max({measure}) FILTER (WHERE id_mes = {m}) AS {names[position]}" for m, names in MONTH_COLUMNS]
    return ", ".join(out)


PIVOT_SQL = f"SELECT id_cliente, {_pivot_cells()} FROM historial_pagos GROUP BY id_cliente"

_CATALOG_SQL = ",\n".join(
    [
        _values("dim_sexo", "id_sexo, descripcion_sexo", SEX_ROWS),
        _values("dim_educacion", "id_educacion, nivel_educativo", EDUCATION_ROWS),
        _values("dim_estado_civil", "id_estado_civil, descripcion_estado_civil", MARITAL_ROWS),
        _values("dim_tiempo_mes", "id_mes, mes_referencia, orden_historial", MONTH_ROWS),
        _values("dim_estatus_pago", "id_estatus, descripcion_estatus", STATUS_ROWS),
    ]
)

#: the star schema as common table expressions; queries continue after it
STAR_SQL = f"""WITH {_CATALOG_SQL},
dim_cliente AS (
  SELECT o_orderkey AS id_cliente, CAST(o_custkey % 2 + 1 AS INTEGER) AS id_sexo,
         CAST(o_custkey % 7 AS INTEGER) AS id_educacion, CAST(o_orderkey % 4 AS INTEGER) AS id_estado_civil,
         CAST(o_custkey % 59 + 21 AS SMALLINT) AS edad, CAST(o_totalprice AS DECIMAL(18,2)) AS limite_credito
  FROM orders),
riesgo_crediticio AS (
  SELECT o_orderkey AS id_cliente, CAST(o_orderstatus = 'F' AS INTEGER) AS incumplimiento_proximo_mes
  FROM orders WHERE o_orderstatus <> 'P'),
historial_pagos AS (
  SELECT l_orderkey AS id_cliente, l_linenumber AS id_mes,
         CAST(CAST(l_quantity AS INTEGER) % 12 - 2 AS INTEGER) AS id_estatus_pago,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS monto_estado_cuenta,
         CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN
           CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS monto_pago_anterior
  FROM lineitem),
historial_ancho AS ({PIVOT_SQL}),
staging AS (
  SELECT c.id_cliente AS ID, limite_credito AS LIMIT_BAL, id_sexo AS SEX, id_educacion AS EDUCATION,
         id_estado_civil AS MARRIAGE, CAST(edad AS INTEGER) AS AGE,
         {", ".join(f"coalesce(h.{c}, 0) AS {c}" for c in PAY_COLUMNS)},
         {", ".join(f"h.{c}" for c in BILL_COLUMNS + PAID_COLUMNS)},
         CAST(o_orderstatus = 'F' AS INTEGER) AS {TARGET_COLUMN}
  FROM dim_cliente c JOIN orders o ON o.o_orderkey = c.id_cliente
  LEFT JOIN historial_ancho h ON h.id_cliente = c.id_cliente),
vw_ml_dataset AS (
  SELECT c.id_cliente, id_sexo, id_educacion, id_estado_civil, edad, limite_credito,
         {", ".join(f"h.{c}" for c in PAY_COLUMNS + BILL_COLUMNS + PAID_COLUMNS)},
         incumplimiento_proximo_mes AS target
  FROM dim_cliente c, historial_ancho h, riesgo_crediticio r
  WHERE c.id_cliente = h.id_cliente AND c.id_cliente = r.id_cliente)
"""

AUDIT_SQL = """WITH base AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 'I' WHEN 'view' THEN 'I' WHEN 'purchase' THEN 'U'
                            WHEN 'click' THEN 'U' ELSE 'D' END AS operacion,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS VARCHAR) AS bit
  FROM events),
auditoria AS (
  SELECT event_id AS id_auditoria, 'riesgo_crediticio' AS tabla_afectada, operacion,
         user_id AS id_registro_afectado, 'usuario_' || user_id AS usuario, ts AS fecha_cambio,
         CASE WHEN operacion <> 'I' THEN bit END AS datos_antes,
         CASE WHEN operacion <> 'D' THEN bit END AS datos_despues
  FROM base)
"""

JOBS_SQL = """WITH trabajos AS (
  SELECT event_id AS id, event_type AS tipo, '/respaldo/' || event_type || '/' || event_id AS ruta, ts AS fecha,
         CASE WHEN event_id % 7 <> 0 THEN CAST(value AS DECIMAL(10,2)) END AS tamano_mb,
         CASE WHEN event_type = 'error' THEN 'Fallido' ELSE 'Completado' END AS estado,
         'usuario_' || user_id AS usuario, CAST(NULL AS VARCHAR) AS notas
  FROM events)
"""

EXPERIMENTS_SQL = """WITH parts AS (
  SELECT event_type AS kind, json_extract_string(props, '$.k') AS k,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS fecha,
         CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS amount, CAST(event_id AS VARCHAR) AS number
  FROM events),
documentos AS (
  SELECT CASE WHEN kind <> 'error' THEN fecha END AS fecha,
         CASE WHEN kind IN ('click', 'view') THEN 'K-Means' WHEN kind = 'purchase' THEN 'Random Forest' END AS algoritmo,
         CASE WHEN kind IN ('click', 'view') THEN k END AS n_clusters,
         CASE WHEN kind = 'purchase' THEN k END AS n_estimators,
         CASE WHEN kind IN ('click', 'view', 'purchase') THEN '0.' || k END AS calidad,
         CASE WHEN kind IN ('click', 'view', 'purchase') THEN amount END AS inercia_f1,
         CASE WHEN kind IN ('click', 'view') THEN number END AS registros
  FROM parts)
"""

SCORES_SQL = """WITH scores AS (
  SELECT doc_id, toxic AS "real", quality AS calidad, n_chars,
         n_chars / (n_chars + 4000.0::DOUBLE) AS probabilidad,
         CAST(n_chars / (n_chars + 4000.0::DOUBLE) >= 0.35::DOUBLE AS INTEGER) AS predicho
  FROM labels JOIN documents USING (doc_id))
"""

HOLES_SQL = """WITH holes AS (
  SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS c_nationkey, c_mktsegment
  FROM customer)
"""
