"""Views, joins, reshaping and dashboard aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import aggregates, audit, filters, reshape, selection
from riskloom.operators import star as star_ops
from riskloom.plans import binding as b
from riskloom.plans.registry import query
from riskloom.schemas import BILL_COLUMNS, MONTH_COLUMNS, PAID_COLUMNS, PAY_COLUMNS, STAGING_SCHEMA
from riskloom.sources.bucketed import store_star

_WIDE = ", ".join(PAY_COLUMNS + BILL_COLUMNS + PAID_COLUMNS)
JOINED_SQL = """FROM dim_cliente c JOIN dim_sexo s USING (id_sexo) JOIN dim_educacion e USING (id_educacion)
  JOIN dim_estado_civil m USING (id_estado_civil) JOIN riesgo_crediticio r USING (id_cliente)"""


@query(
    b.STAR_SQL
    + """SELECT count(DISTINCT id_cliente) AS total,
  round(CAST(sum(limite_credito) AS DOUBLE) / count(*), 4) AS avg_limite,
  round(CAST(sum(edad) AS DOUBLE) / count(*), 6) AS avg_edad,
  round(100.0::DOUBLE * sum(incumplimiento_proximo_mes) / count(*), 6) AS tasa
  FROM dim_cliente JOIN riesgo_crediticio USING (id_cliente)"""
)
def client_kpis(spark, sf_dir):
    kpis = star_ops.client_kpis(b.star(spark, sf_dir))
    return kpis.select(
        "total", F.round("avg_limite", 4).alias("avg_limite"), F.round("avg_edad", 6).alias("avg_edad"),
        F.round("tasa", 6).alias("tasa"),
    )


@query(
    b.STAR_SQL
    + """SELECT CAST(trunc(CAST(sum(edad) AS DOUBLE) / count(*)) AS BIGINT) AS avg_edad
  FROM dim_cliente JOIN riesgo_crediticio USING (id_cliente)"""
)
def client_kpis_integer_mean(spark, sf_dir):
    return star_ops.client_kpis(b.star(spark, sf_dir), truncate_int_avg=True).select("avg_edad")


@query(
    """SELECT count(DISTINCT c_custkey) AS clientes, round(avg(o_totalprice), 4) AS precio_medio,
  round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS tasa
  FROM customer JOIN orders ON c_custkey = o_custkey"""
)
def customer_order_kpis(spark, sf_dir):
    """Orders are summed per customer before the join, so a hot customer is one row."""
    per_customer = (
        b.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
            F.count_if(F.col("o_orderstatus") == "F").alias("cerrados"),
        )
    )
    return (
        b.table(spark, sf_dir, "customer")
        .select("c_custkey")
        .join(per_customer, "c_custkey")
        .agg(
            F.countDistinct("c_custkey").alias("clientes"),
            F.round(F.try_divide(F.sum("total").cast("double"), F.sum("n")), 4).alias("precio_medio"),
            F.round(S.percent(F.sum("cerrados"), F.sum("n")), 6).alias("tasa"),
        )
    )


@query(
    b.STAR_SQL
    + """SELECT nivel_educativo, count(*) AS cantidad FROM dim_cliente JOIN dim_educacion USING (id_educacion)
  GROUP BY nivel_educativo"""
)
def count_by_education(spark, sf_dir):
    s = b.star(spark, sf_dir)
    return star_ops.count_by_label(
        s.dim_cliente, "id_educacion", s.catalog("dim_educacion"), "id_educacion", "nivel_educativo"
    )


@query(
    b.STAR_SQL
    + """SELECT descripcion_estado_civil, count(*) AS cantidad FROM dim_cliente
  JOIN dim_estado_civil USING (id_estado_civil) GROUP BY descripcion_estado_civil"""
)
def count_by_marital_status(spark, sf_dir):
    s = b.star(spark, sf_dir)
    return star_ops.count_by_label(
        s.dim_cliente, "id_estado_civil", s.catalog("dim_estado_civil"), "id_estado_civil", "descripcion_estado_civil"
    )


@query(
    b.STAR_SQL
    + f"""SELECT id_cliente, descripcion_sexo AS sexo, nivel_educativo AS educacion,
  descripcion_estado_civil AS estado_civil, edad, limite_credito, incumplimiento_proximo_mes AS target {JOINED_SQL}"""
)
def client_detail_view(spark, sf_dir):
    return star_ops.client_detail(b.star(spark, sf_dir))


@query(
    b.STAR_SQL
    + f"""SELECT id_cliente, descripcion_sexo, nivel_educativo, descripcion_estado_civil, edad, limite_credito,
  incumplimiento_proximo_mes {JOINED_SQL} ORDER BY id_cliente LIMIT 10"""
)
def star_enrich_top(spark, sf_dir):
    return star_ops.first_clients(b.star(spark, sf_dir), 10)


@query(
    b.STAR_SQL
    + """SELECT id_cliente, mes_referencia, descripcion_estatus AS estado_de_pago, monto_estado_cuenta,
  monto_pago_anterior FROM historial_pagos h JOIN dim_tiempo_mes USING (id_mes)
  JOIN dim_estatus_pago p ON h.id_estatus_pago = p.id_estatus WHERE id_cliente = 52"""
)
def fact_history_of_key(spark, sf_dir):
    return star_ops.client_history(b.star(spark, sf_dir), 52)


@query(
    b.STAR_SQL
    + """SELECT id_cliente, mes_referencia, descripcion_estatus AS estado_de_pago, monto_estado_cuenta
  FROM historial_pagos h JOIN dim_tiempo_mes USING (id_mes)
  JOIN dim_estatus_pago p ON h.id_estatus_pago = p.id_estatus"""
)
def fact_history_enriched(spark, sf_dir):
    s = b.star(spark, sf_dir)
    return (
        s.historial_pagos.join(F.broadcast(s.catalog("dim_tiempo_mes")), "id_mes")
        .join(F.broadcast(s.catalog("dim_estatus_pago")), F.col("id_estatus_pago") == F.col("id_estatus"))
        .select(
            "id_cliente", "mes_referencia", F.col("descripcion_estatus").alias("estado_de_pago"), "monto_estado_cuenta"
        )
    )


@query(b.STAR_SQL + "SELECT * FROM historial_ancho")
def history_pivot(spark, sf_dir):
    return reshape.pivot_history(b.history(spark, sf_dir))


@query(b.STAR_SQL + "SELECT * FROM vw_ml_dataset")
def ml_dataset(spark, sf_dir):
    return star_ops.ml_dataset(b.star(spark, sf_dir))


@query(b.STAR_SQL + "SELECT * FROM vw_ml_dataset")
def ml_dataset_bucketed(spark, sf_dir):
    """The dataset from a star stored in buckets by client; only the storing shuffles."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return star_ops.ml_dataset(store_star(b.star(spark, sf_dir), "estrella", buckets))


@query(
    b.STAR_SQL
    + f"""SELECT id_cliente AS "ID", id_sexo AS "SEX", id_educacion AS "EDUCATION", id_estado_civil AS "MARRIAGE",
  edad AS "AGE", limite_credito AS "LIMIT_BAL", {_WIDE}, target AS "default payment next month" FROM vw_ml_dataset"""
)
def ml_dataset_model_names(spark, sf_dir):
    return filters.to_model_names(star_ops.ml_dataset(b.star(spark, sf_dir)))


_REPORT = filters.report_names([f for f in STAGING_SCHEMA.names])


@query(
    b.STAR_SQL
    + "SELECT "
    + ", ".join(
        (
            f"CASE WHEN {old} IN (0, 5, 6) THEN 4 ELSE {old} END AS \"{new}\""
            if old == "EDUCATION"
            else f"CASE WHEN {old} = 0 THEN 3 ELSE {old} END AS \"{new}\""
            if old == "MARRIAGE"
            else f'{old} AS "{new}"'
        )
        for old, new in _REPORT.items()
    )
    + " FROM staging"
)
def report_names_recoded(spark, sf_dir):
    """Renamed by dictionary, id dropped, undocumented codes folded."""
    renamed = filters.to_report_names(b.staging(spark, sf_dir))
    return filters.recode_categories(filters.drop_present(renamed, "ID", "Cluster"))


@query(
    b.STAR_SQL
    + "".join(
        ("" if m == 1 else " UNION ALL ")
        + f"SELECT ID AS id_cliente, {m} AS id_mes, {p} AS id_estatus_pago, {bill} AS monto_estado_cuenta, "
        f"{paid} AS monto_pago_anterior FROM staging"
        for m, (p, bill, paid) in MONTH_COLUMNS
    )
)
def history_unpivot(spark, sf_dir):
    return reshape.unpivot_history(b.staging(spark, sf_dir))


@query(
    b.STAR_SQL
    + """SELECT id_educacion, count(*) FILTER (WHERE target = 0) AS target_0, count(*) FILTER (WHERE target = 1) AS target_1
  FROM vw_ml_dataset GROUP BY id_educacion"""
)
def cross_table_counts(spark, sf_dir):
    return reshape.cross_table(star_ops.ml_dataset(b.star(spark, sf_dir)), "id_educacion", "target", [0, 1])


@query(
    b.STAR_SQL
    + "".join(
        ("" if i == 0 else " UNION ALL ")
        + f"SELECT id_cliente, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM historial_ancho"
        for i, c in enumerate(BILL_COLUMNS)
    )
)
def bill_columns_to_rows(spark, sf_dir):
    return reshape.to_variables(reshape.pivot_history(b.history(spark, sf_dir)), BILL_COLUMNS, ["id_cliente"])


@query(
    b.STAR_SQL
    + """SELECT (SELECT count(*) FROM staging) AS total_staging, (SELECT count(*) FROM dim_cliente) AS total_clientes,
  (SELECT count(*) FROM riesgo_crediticio) AS total_riesgo, (SELECT count(*) FROM historial_pagos) AS total_historial,
  (SELECT count(*) FROM staging) AS pendientes_por_migrar"""
)
def migration_summary(spark, sf_dir):
    return star_ops.migration_summary(b.staging(spark, sf_dir), b.star(spark, sf_dir))


@query(
    b.STAR_SQL
    + """SELECT (SELECT count(*) FROM dim_cliente) AS total_clientes,
  (SELECT count(*) FROM riesgo_crediticio) AS total_target_riesgo,
  (SELECT count(*) FROM historial_pagos) AS total_registros_historial,
  (SELECT count(*) * 6 FROM dim_cliente) AS total_historial_esperado,
  CAST((SELECT count(*) FROM historial_pagos) = (SELECT count(*) * 6 FROM dim_cliente) AS INTEGER) AS concilia"""
)
def reconcile_counts(spark, sf_dir):
    return star_ops.reconcile(b.star(spark, sf_dir))


@query(
    """SELECT r_regionkey, r_name, (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM nation
  WHERE n_regionkey = r_regionkey) AS miembros FROM region"""
)
def string_agg_by_entity(spark, sf_dir):
    """The names of all nations by region."""
    nations = b.table(spark, sf_dir, "nation")
    links = nations.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    return aggregates.members_by_entity(
        b.table(spark, sf_dir, "region"), "r_regionkey", "r_name", links, "n_nationkey", nations, "n_name"
    )


@query(
    """SELECT c_mktsegment, count(*) AS cantidad,
  round(100.0::DOUBLE * count(*) / (SELECT count(c_mktsegment) FROM customer), 2) AS porcentaje
  FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment"""
)
def value_frequency(spark, sf_dir):
    return aggregates.value_frequency(b.table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    b.STAR_SQL
    + "SELECT id_sexo, target, count(*) AS cantidad FROM vw_ml_dataset GROUP BY id_sexo, target"
)
def two_way_counts(spark, sf_dir):
    return aggregates.two_way_counts(star_ops.ml_dataset(b.star(spark, sf_dir)), "id_sexo", "target")


@query("SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority")
def distinct_sorted(spark, sf_dir):
    return selection.distinct_sorted(b.table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
  SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS distintos, CAST(sum(c - 1) AS BIGINT) AS duplicados FROM g"""
)
def duplicate_count(spark, sf_dir):
    return selection.count_duplicates(b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def drop_duplicates(spark, sf_dir):
    return selection.without_duplicates(b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    b.STAR_SQL
    + """SELECT id_educacion, round(avg(CAST(limite_credito AS DOUBLE)), 2) AS limite_credito,
  round(avg(edad), 2) AS edad, round(avg(CAST("PAY_0" AS DOUBLE)), 2) AS "PAY_0",
  round(avg(CAST(BILL_AMT1 AS DOUBLE)), 2) AS "BILL_AMT1", round(avg(CAST(PAY_AMT1 AS DOUBLE)), 2) AS "PAY_AMT1",
  round(avg(target) * 100, 2) AS tasa_default_pct FROM vw_ml_dataset GROUP BY id_educacion"""
)
def group_profile(spark, sf_dir):
    return aggregates.group_means(
        star_ops.ml_dataset(b.star(spark, sf_dir)),
        "id_educacion",
        ["limite_credito", "edad", "PAY_0", "BILL_AMT1", "PAY_AMT1"],
        "target",
    )


@query(
    b.STAR_SQL
    + """SELECT id_educacion, round(avg(CAST(limite_credito AS DOUBLE)), 2) AS limite_credito_media,
  round(median(CAST(limite_credito AS DOUBLE)), 2) AS limite_credito_mediana,
  round(stddev_samp(CAST(limite_credito AS DOUBLE)), 2) AS limite_credito_desvest,
  round(avg(edad), 2) AS edad_media, round(median(CAST(edad AS DOUBLE)), 2) AS edad_mediana,
  round(avg(target) * 100, 2) AS tasa_default_pct, count(target) AS tamano
  FROM vw_ml_dataset GROUP BY id_educacion"""
)
def group_stats(spark, sf_dir):
    data = b.stored_dataset(spark, sf_dir, "id_educacion", "limite_credito", "edad", "target")
    return aggregates.group_statistics(data, "id_educacion", "limite_credito", "edad", "target")


@query(
    b.STAR_SQL
    + """SELECT count(*) AS clientes, round(avg(target) * 100, 6) AS tasa_default,
  round(avg(CAST(limite_credito AS DOUBLE)), 4) AS limite_promedio, round(avg(edad), 6) AS edad_promedio
  FROM vw_ml_dataset WHERE id_educacion = 2"""
)
def group_summary(spark, sf_dir):
    one = aggregates.group_summary(
        star_ops.ml_dataset(b.star(spark, sf_dir)), "id_educacion", 2, "target", "limite_credito", "edad"
    )
    return one.select(
        "clientes", F.round("tasa_default", 6).alias("tasa_default"),
        F.round("limite_promedio", 4).alias("limite_promedio"), F.round("edad_promedio", 6).alias("edad_promedio"),
    )


@query("SELECT label, count(*) AS tamano FROM embeddings GROUP BY label ORDER BY label")
def group_sizes(spark, sf_dir):
    return aggregates.group_sizes(b.table(spark, sf_dir, "embeddings"), "label")


@query(b.STAR_SQL + "SELECT round(avg(target) * 100, 6) AS tasa_default_global FROM vw_ml_dataset")
def global_rate(spark, sf_dir):
    rate = aggregates.global_rate(star_ops.ml_dataset(b.star(spark, sf_dir)), "target")
    return rate.select(F.round("tasa_default_global", 6).alias("tasa_default_global"))


@query(
    "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, "
    "round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem"
)
def column_means(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    means = aggregates.column_means(b.table(spark, sf_dir, "lineitem"), names)
    return means.select(
        *[F.round(c, 4 if c == "l_extendedprice" else 6).alias(c) for c in names]
    )


@query(
    b.AUDIT_SQL
    + """SELECT count(*) AS total, count(*) FILTER (WHERE operacion = 'I') AS inserts,
  count(*) FILTER (WHERE operacion = 'U') AS updates, count(*) FILTER (WHERE operacion = 'D') AS deletes,
  max(fecha_cambio) AS ultimo FROM auditoria"""
)
def audit_summary(spark, sf_dir):
    return audit.audit_summary(b.audit_log(spark, sf_dir))


@query(b.AUDIT_SQL + "SELECT * FROM auditoria WHERE operacion = 'D' ORDER BY fecha_cambio DESC, id_auditoria DESC LIMIT 50")
def audit_latest(spark, sf_dir):
    return audit.latest_changes(b.audit_log(spark, sf_dir), "D", 50)


@query(b.AUDIT_SQL + "SELECT * FROM auditoria ORDER BY fecha_cambio DESC, id_auditoria DESC LIMIT 50")
def audit_latest_all(spark, sf_dir):
    return audit.latest_changes(b.audit_log(spark, sf_dir), "Todas", 50)


@query(b.JOBS_SQL + "SELECT * FROM trabajos ORDER BY fecha DESC, id DESC LIMIT 50")
def job_history_latest(spark, sf_dir):
    return audit.latest_jobs(b.job_history(spark, sf_dir), 50)


@query(
    b.JOBS_SQL
    + """, nuevos AS (SELECT * FROM trabajos ORDER BY fecha DESC, id DESC LIMIT 50)
  SELECT count(*) AS total, count(*) FILTER (WHERE fecha >= TIMESTAMP '2024-01-30 00:00:00') AS hoy,
  coalesce(CAST(sum(tamano_mb) AS DOUBLE), 0) AS espacio_total_mb,
  coalesce(strftime(max(fecha), '%Y-%m-%d %H:%M'), 'N/A') AS ultimo FROM nuevos"""
)
def history_kpis_top50(spark, sf_dir):
    return audit.job_kpis(b.job_history(spark, sf_dir), datetime(2024, 1, 30, 17, 30), 50)


@query(
    """SELECT min(event_id) AS id, 'plan_' || user_id AS nombre, event_type AS tipo, 'Diario' AS frecuencia,
  strftime(min(ts), '%H:%M') AS hora, CASE WHEN user_id % 2 = 1 THEN 'Activo' ELSE 'Inactivo' END AS estado,
  min(ts) AS ultima_ejecucion, max(ts) AS proxima_ejecucion FROM events GROUP BY user_id, event_type"""
)
def schedule_listing(spark, sf_dir):
    return audit.schedule_listing(b.job_schedules(spark, sf_dir))


@query(
    """SELECT event_id, event_type IN ('click', 'view') AS dentro, event_type NOT IN ('click', 'view') AS fuera
  FROM events"""
)
def in_list_flags(spark, sf_dir):
    kinds = ["click", "view"]
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        filters.in_list("event_type", kinds).alias("dentro"),
        filters.in_list("event_type", kinds, negate=True).alias("fuera"),
    )


@query("SELECT CAST(EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 500000) AS INTEGER) AS existe")
def exists_flag(spark, sf_dir):
    return filters.exists_flag(b.table(spark, sf_dir, "orders"), F.col("o_totalprice") > 500000)


@query(
    b.HOLES_SQL
    + "SELECT * FROM holes WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL"
)
def complete_rows(spark, sf_dir):
    return filters.complete_rows(b.customers_with_holes(spark, sf_dir))


@query(b.STAR_SQL + "SELECT edad AS x, limite_credito AS y, target AS clase FROM vw_ml_dataset")
def scatter_age_limit(spark, sf_dir):
    return filters.scatter_points(star_ops.ml_dataset(b.star(spark, sf_dir)), "edad", "limite_credito", "target")


@query(b.STAR_SQL + "SELECT BILL_AMT1 AS x, PAY_AMT1 AS y, target AS clase FROM vw_ml_dataset")
def scatter_bill_payment(spark, sf_dir):
    return filters.scatter_points(star_ops.ml_dataset(b.star(spark, sf_dir)), "BILL_AMT1", "PAY_AMT1", "target")


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey IN (0, 5, 6) THEN 4 ELSE n_nationkey END AS recodificado FROM nation"""
)
def recode_values(spark, sf_dir):
    nations = b.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("recodificado"))
    return filters.recode(nations, "recodificado", filters.EDUCATION_RECODE)


@query(
    """SELECT doc_id, CASE toxic WHEN 0 THEN 'No Default' WHEN 1 THEN 'Default' END AS clase,
  CASE WHEN quality = 1 THEN 'ALTO RIESGO DE DEFAULT' ELSE 'BAJO RIESGO' END AS riesgo FROM labels"""
)
def label_case(spark, sf_dir):
    return b.table(spark, sf_dir, "labels").select(
        "doc_id", S.class_label("toxic").alias("clase"), S.risk_label("quality").alias("riesgo")
    )


@query(
    """(SELECT o_orderkey, o_totalprice, 'first' AS place FROM orders ORDER BY o_orderkey LIMIT 5)
  UNION ALL (SELECT o_orderkey, o_totalprice, 'last' AS place FROM orders ORDER BY o_orderkey DESC LIMIT 5)"""
)
def first_and_last_rows(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return selection.head_and_tail(rows, "o_orderkey", 5)


@query(
    """SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS bit,
  CAST(CAST(event_type = 'error' AS INTEGER) AS VARCHAR) AS bit_texto,
  TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS numero,
  coalesce(CASE WHEN event_id % 7 <> 0 THEN event_id END, 0) AS sin_nulo,
  round_even(CAST(event_id AS DOUBLE) / 8, 2) AS redondeo,
  event_id * 8 AS kb, CAST(floor(event_id * 8 / 1024.0::DOUBLE) AS BIGINT) AS mb,
  abs(event_id - 500) AS distancia,
  'dbo.' || event_type AS nombre, event_id || ' - ' || event_type || ' - ' || user_id AS etiqueta,
  CAST(split_part(event_id || ' - ' || event_type, ' - ', 1) AS INTEGER) AS etiqueta_id,
  substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, 19) AS fecha_corta,
  strftime(ts, '%Y-%m-%d %H:%M') AS minuto, strftime(ts, '%Y%m%d_%H%M%S') AS sello,
  upper(event_type) AS mayusculas, starts_with(event_type, 's') AS empieza,
  date_trunc('day', ts) AS dia FROM events"""
)
def scalar_functions(spark, sf_dir):
    error = F.col("event_type") == "error"
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        S.bit_int(error).alias("bit"),
        S.bit_text(error).alias("bit_texto"),
        S.to_number(F.get_json_object("props", "$.k")).alias("numero"),
        S.zero_if_null(F.when(F.col("event_id") % 7 != 0, F.col("event_id"))).alias("sin_nulo"),
        S.round_half_even(F.col("event_id").cast("double") / 8, 2).alias("redondeo"),
        S.pages_to_kb("event_id").alias("kb"),
        S.kb_to_mb(S.pages_to_kb("event_id")).alias("mb"),
        F.abs(F.col("event_id") - 500).alias("distancia"),
        S.qualified_name(F.lit("dbo"), "event_type").alias("nombre"),
        S.row_label("event_id", "event_type", "user_id").alias("etiqueta"),
        S.label_id(S.row_label("event_id", "event_type")).alias("etiqueta_id"),
        S.short_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("fecha_corta"),
        S.minute_text("ts").alias("minuto"),
        S.compact_time("ts").alias("sello"),
        F.upper("event_type").alias("mayusculas"),
        F.startswith("event_type", F.lit("s")).alias("empieza"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("dia"),
    )
