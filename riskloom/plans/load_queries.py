"""Loading, integrity, change capture, sources and the experiment log."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import audit, filters, integrity, migration
from riskloom.operators.reshape import counts_side_by_side
from riskloom.operators.selection import split_first_n
from riskloom.plans import binding as b
from riskloom.plans.registry import query
from riskloom.plans.star_queries import JOINED_SQL
from riskloom.schemas import BILL_COLUMNS, MONTH_COLUMNS, PAID_COLUMNS, PAY_COLUMNS, STAGING_SCHEMA
from riskloom.session import materialize, scratch_path
from riskloom.sources import csvfiles, documents, tables
from riskloom.sources.batches import CreditStore, load_star
from riskloom.streaming import batch_loads

#: rows asked for in the batch queries; below the top-n switch of ``split_first_n``, whose other way ``first_n_by_key`` takes
BATCH = 4_000

_BATCH_SQL = f"lote AS (SELECT * FROM staging ORDER BY ID LIMIT {BATCH})"
_MONTHS_SQL = " UNION ALL ".join(
    f"SELECT ID AS id_cliente, {m} AS id_mes, {p} AS id_estatus_pago, {bill} AS monto_estado_cuenta, "
    f"{paid} AS monto_pago_anterior FROM lote"
    for m, (p, bill, paid) in MONTH_COLUMNS
)


@query(b.STAR_SQL + "SELECT * FROM staging ORDER BY ID LIMIT 10")
def staging_preview(spark, sf_dir):
    return migration.preview_batch(b.staging(spark, sf_dir), 10)


def _batch(spark, sf_dir):
    """One batch from a frozen staging table, as staging is a stored table."""
    frozen = materialize(b.staging(spark, sf_dir), "staging")
    return migration.migrate_batch(frozen, b.loaded_star(spark, sf_dir), BATCH)


@query(
    b.STAR_SQL
    + f""", {_BATCH_SQL} SELECT ID AS id_cliente, SEX AS id_sexo, EDUCATION AS id_educacion, MARRIAGE AS id_estado_civil,
  CAST(AGE AS SMALLINT) AS edad, LIMIT_BAL AS limite_credito FROM lote
  WHERE NOT EXISTS (SELECT 1 FROM dim_cliente c WHERE c.id_cliente % 3 = 0 AND c.id_cliente = lote.ID)"""
)
def migrate_batch_clients(spark, sf_dir):
    return _batch(spark, sf_dir).new_clients


@query(
    b.STAR_SQL
    + f""", {_BATCH_SQL} SELECT ID AS id_cliente, default_payment_next_month AS incumplimiento_proximo_mes FROM lote
  WHERE NOT EXISTS (SELECT 1 FROM riesgo_crediticio c WHERE c.id_cliente % 3 = 0 AND c.id_cliente = lote.ID)"""
)
def migrate_batch_targets(spark, sf_dir):
    return _batch(spark, sf_dir).new_targets


@query(
    b.STAR_SQL
    + f""", {_BATCH_SQL}, meses AS ({_MONTHS_SQL})
  SELECT * FROM meses WHERE NOT EXISTS (SELECT 1 FROM historial_pagos h WHERE h.id_cliente % 3 = 0
    AND h.id_cliente = meses.id_cliente AND h.id_mes = meses.id_mes AND h.id_estatus_pago = meses.id_estatus_pago)"""
)
def migrate_batch_history(spark, sf_dir):
    return _batch(spark, sf_dir).new_history


@query(
    b.STAR_SQL
    + f""", {_BATCH_SQL} SELECT CAST({BATCH} AS BIGINT) AS registros_solicitados, (SELECT count(*) FROM lote) AS registros_migrados,
  (SELECT count(*) FROM staging WHERE ID NOT IN (SELECT ID FROM lote)) AS registros_restantes_staging"""
)
def migrate_batch_report(spark, sf_dir):
    return migration.plan_batch(materialize(b.staging(spark, sf_dir), "staging"), BATCH).report


@query(b.STAR_SQL + f", {_BATCH_SQL} SELECT * FROM staging WHERE ID NOT IN (SELECT ID FROM lote)")
def staging_remaining(spark, sf_dir):
    return migration.plan_batch(materialize(b.staging(spark, sf_dir), "staging"), BATCH).staging


@query(
    b.STAR_SQL
    + """, publicado AS (SELECT id_cliente, id_sexo FROM dim_cliente)
  SELECT (SELECT count(*) FROM publicado) AS total_clientes, (SELECT count(*) FROM dim_cliente) AS total_riesgo,
  (SELECT count(*) * 6 FROM dim_cliente) AS total_historial, CAST(0 AS BIGINT) AS total_staging"""
)
def batch_store_load(spark, sf_dir):
    """Two published batches empty the staging table; counts of what readers then see."""
    store = CreditStore(spark, scratch_path(spark, "store"))
    store.load_staging(b.staging(spark, sf_dir))
    store.migrate(BATCH)
    if store.staging().limit(1).count():
        store.migrate_all()
    star = store.star()
    return counts_side_by_side(
        {
            "total_clientes": star.dim_cliente,
            "total_riesgo": star.riesgo_crediticio,
            "total_historial": star.historial_pagos,
            "total_staging": store.staging(),
        }
    )


_COUNTS_SQL = """SELECT (SELECT count(*) FROM dim_cliente WHERE {0}) AS total_clientes,
  (SELECT count(*) FROM dim_cliente WHERE {0}) AS total_riesgo, (SELECT count(*) * 6 FROM dim_cliente WHERE {0}) AS total_historial"""


def _star_counts(star):
    return counts_side_by_side(
        {"total_clientes": star.dim_cliente, "total_riesgo": star.riesgo_crediticio, "total_historial": star.historial_pagos}
    )


@query(b.STAR_SQL + _COUNTS_SQL.format("id_cliente NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)"))
def stored_deletes(spark, sf_dir):
    """Clients deleted from a store between two batches and after them, then compacted: what readers see."""
    store = CreditStore(spark, scratch_path(spark, "store"))
    store.load_staging(b.staging(spark, sf_dir))
    gone = b.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id_cliente"))
    store.migrate(BATCH)
    store.delete_clients(gone)
    if not store.staging().isEmpty():
        store.migrate_all()
    store.delete_clients(gone)  # the second batch brought others of them
    store.compact()
    return _star_counts(store.star())


@query(b.STAR_SQL + "SELECT * FROM staging WHERE ID NOT IN (SELECT ID FROM staging ORDER BY ID LIMIT 1500)")
def stored_delete_first(spark, sf_dir):
    """Staging of a store after two deletes of its first rows."""
    store = CreditStore(spark, scratch_path(spark, "store"))
    store.load_staging(b.staging(spark, sf_dir))
    store.delete_first(1_000)
    store.delete_first(500)
    return store.staging()


@query(b.STAR_SQL + _COUNTS_SQL.format("true"))
def stream_batch_load(spark, sf_dir):
    """Staging rows that arrive in four files, one commit a micro-batch, and the whole stream replayed."""
    arrivals, store = scratch_path(spark, "arrivals"), CreditStore(spark, scratch_path(spark, "store"))
    b.staging(spark, sf_dir).repartitionByRange(4, "ID").write.parquet(arrivals)
    for _ in range(2):  # the replay knows nothing of the first run
        stream = batch_loads.read_arrivals(spark, arrivals, 1)
        batch_loads.load_arrivals(stream, store, scratch_path(spark, "checkpoint")).awaitTermination()
    return _star_counts(store.star())


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4000)"""
)
def delete_first_n(spark, sf_dir):
    ids = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"), "o_custkey")
    remaining, _ = migration.delete_first_n(ids, BATCH)
    return remaining.withColumnRenamed("ID", "o_orderkey")


@query(
    """SELECT CAST(4000 AS BIGINT) AS registros_solicitados, least(4000, count(*)) AS registros_eliminados,
  count(*) - least(4000, count(*)) AS registros_restantes_staging FROM orders"""
)
def delete_first_n_report(spark, sf_dir):
    ids = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"))
    return migration.delete_first_n(ids, BATCH)[1]


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
  QUALIFY row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) <= 20000"""
)
def first_n_by_key(spark, sf_dir):
    """Twenty thousand lines in (order, line) order: the n-th key is found by counting, ties by order of line."""
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    # one sortable number per (order, line, part)
    ordered = lines.withColumn(
        "orden",
        (F.col("l_orderkey").cast("decimal(20,0)") * 8 + F.col("l_linenumber")) * 100_000_000_000 + F.col("l_partkey"),
    ).withColumn("orden", F.col("orden").cast("decimal(38,0)"))
    first, _ = split_first_n(ordered, "orden", 20_000)
    return first.drop("orden")


_GONE = "SELECT o_orderkey AS id_cliente FROM orders WHERE o_totalprice > 400000"


def _without_expensive(spark, sf_dir):
    ids = b.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id_cliente"))
    return migration.delete_clients(b.star(spark, sf_dir), ids)


@query(
    b.STAR_SQL
    + f""", ids AS ({_GONE}) SELECT 'dim_cliente' AS tabla, count(*) AS filas FROM dim_cliente
  WHERE id_cliente NOT IN (FROM ids) UNION ALL SELECT 'riesgo_crediticio', count(*) FROM riesgo_crediticio
  WHERE id_cliente NOT IN (FROM ids) UNION ALL SELECT 'historial_pagos', count(*) FROM historial_pagos
  WHERE id_cliente NOT IN (FROM ids)"""
)
def delete_keys_cascade(spark, sf_dir):
    star, _ = _without_expensive(spark, sf_dir)
    return documents.count_by_collection(
        {"dim_cliente": star.dim_cliente, "riesgo_crediticio": star.riesgo_crediticio, "historial_pagos": star.historial_pagos}
    ).select(F.col("coleccion").alias("tabla"), F.col("documentos").alias("filas"))


@query(
    b.STAR_SQL
    + f", ids AS ({_GONE}) SELECT * FROM historial_pagos WHERE id_cliente NOT IN (FROM ids)"
)
def delete_keys_history(spark, sf_dir):
    return _without_expensive(spark, sf_dir)[0].historial_pagos


def _full_load(spark, sf_dir):
    return load_star(b.staging(spark, sf_dir), scratch_path(spark, "star"))


@query(b.STAR_SQL + """SELECT ID AS id_cliente, SEX AS id_sexo, EDUCATION AS id_educacion, MARRIAGE AS id_estado_civil,
  CAST(AGE AS SMALLINT) AS edad, LIMIT_BAL AS limite_credito FROM staging""")
def full_load_clients(spark, sf_dir):
    """The full load, written and read back: clients."""
    return _full_load(spark, sf_dir).dim_cliente


@query(b.STAR_SQL + "SELECT ID AS id_cliente, default_payment_next_month AS incumplimiento_proximo_mes FROM staging")
def full_load_targets(spark, sf_dir):
    return _full_load(spark, sf_dir).riesgo_crediticio


@query(b.STAR_SQL + f", lote AS (SELECT * FROM staging) {_MONTHS_SQL}")
def full_load_history(spark, sf_dir):
    return _full_load(spark, sf_dir).historial_pagos


@query(
    b.STAR_SQL
    + f"""SELECT id_cliente, descripcion_sexo AS sexo, nivel_educativo AS educacion,
  descripcion_estado_civil AS estado_civil, edad, limite_credito, incumplimiento_proximo_mes AS target {JOINED_SQL}"""
)
def descriptive_view(spark, sf_dir):
    """The descriptive view by name."""
    tables.register_views(b.star(spark, sf_dir), b.staging(spark, sf_dir))
    return tables.read_view(spark, "vw_cliente_detallado")


@query(
    b.STAR_SQL
    + """SELECT '' AS esquema, 'dim_cliente' AS tabla, 'VIEW' AS tipo, count(*) AS filas FROM dim_cliente
  UNION ALL SELECT '', 'historial_pagos', 'VIEW', count(*) FROM historial_pagos
  UNION ALL SELECT '', 'riesgo_crediticio', 'VIEW', count(*) FROM riesgo_crediticio"""
)
def table_listing(spark, sf_dir):
    """Registered tables of the star, without the catalogs, and the rows of each."""
    tables.register_views(b.star(spark, sf_dir), b.staging(spark, sf_dir))
    listed = tables.list_tables(spark, "VIEW")
    listed = listed.where(F.col("tabla").isin("dim_cliente", "historial_pagos", "riesgo_crediticio"))
    return tables.with_row_counts(spark, listed)


@query("""SELECT 's_suppkey' AS columna, 'numerica' AS clase, count(DISTINCT s_suppkey) AS distintos,
    min(s_suppkey)::DOUBLE AS minimo, max(s_suppkey)::DOUBLE AS maximo FROM supplier
  UNION ALL SELECT 's_nationkey', 'categorica', count(DISTINCT s_nationkey), min(s_nationkey)::DOUBLE, max(s_nationkey)::DOUBLE FROM supplier
  UNION ALL SELECT 's_acctbal', 'numerica', count(DISTINCT s_acctbal), min(s_acctbal)::DOUBLE, max(s_acctbal)::DOUBLE FROM supplier""")
def column_classes(spark, sf_dir):
    """Numeric columns of a table apart from those declared categorical, with their distinct values and range."""
    supplier = b.table(spark, sf_dir, "supplier")
    return filters.class_facts(supplier.select(*filters.numeric_columns(supplier)), ["s_nationkey"])


_SNAPSHOTS_SQL = b.STAR_SQL + """, antes AS (SELECT * FROM riesgo_crediticio WHERE id_cliente % 5 <> 0),
despues AS (SELECT id_cliente, CASE WHEN id_cliente % 11 = 0 THEN 1 - incumplimiento_proximo_mes
    ELSE incumplimiento_proximo_mes END AS incumplimiento_proximo_mes
  FROM riesgo_crediticio WHERE id_cliente % 7 <> 0)
SELECT 'riesgo_crediticio' AS tabla_afectada,
  CASE WHEN a.id_cliente IS NULL THEN 'I' WHEN d.id_cliente IS NULL THEN 'D' ELSE 'U' END AS operacion,
  coalesce(a.id_cliente, d.id_cliente) AS id_registro_afectado,
  CAST(a.incumplimiento_proximo_mes AS VARCHAR) AS datos_antes,
  CAST(d.incumplimiento_proximo_mes AS VARCHAR) AS datos_despues
FROM antes a FULL JOIN despues d ON a.id_cliente = d.id_cliente"""


def _snapshots(spark, sf_dir):
    whole = b.targets(spark, sf_dir)
    value = F.col("incumplimiento_proximo_mes")
    after = whole.where("id_cliente % 7 <> 0").withColumn(
        "incumplimiento_proximo_mes", F.when(F.col("id_cliente") % 11 == 0, 1 - value).otherwise(value)
    )
    return whole.where("id_cliente % 5 <> 0"), after


@query(_SNAPSHOTS_SQL + " WHERE a.incumplimiento_proximo_mes IS DISTINCT FROM d.incumplimiento_proximo_mes")
def snapshot_audit(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    changes = audit.snapshot_changes(before, after, "id_cliente", "incumplimiento_proximo_mes")
    return audit.audit_rows(changes).drop("usuario", "fecha_cambio")


@query(_SNAPSHOTS_SQL)
def snapshot_audit_unchanged(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    changes = audit.snapshot_changes(before, after, "id_cliente", "incumplimiento_proximo_mes", include_unchanged=True)
    return audit.audit_rows(changes).drop("usuario", "fecha_cambio")


@query("SELECT l_orderkey, l_linenumber, count(*) AS filas FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_violations(spark, sf_dir):
    return integrity.key_violations(b.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _orphan_sql(name: str, child: str, key: str, parent: str, parent_key: str) -> str:
    return (
        f"SELECT '{name}' AS restriccion, count(DISTINCT {key}) AS claves_huerfanas, count(*) AS filas_huerfanas "
        f"FROM {child} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {parent_key} FROM {parent})"
    )


@query(
    b.STAR_SQL
    + " UNION ALL ".join(
        [
            _orphan_sql("FK_Cliente_Sexo", "dim_cliente", "id_sexo", "dim_sexo", "id_sexo"),
            _orphan_sql("FK_Cliente_Educacion", "dim_cliente", "id_educacion", "dim_educacion", "id_educacion"),
            _orphan_sql("FK_Cliente_EstadoCivil", "dim_cliente", "id_estado_civil", "dim_estado_civil", "id_estado_civil"),
            _orphan_sql("FK_Historial_Cliente", "historial_pagos", "id_cliente", "dim_cliente", "id_cliente"),
            _orphan_sql("FK_Historial_Mes", "historial_pagos", "id_mes", "dim_tiempo_mes", "id_mes"),
            _orphan_sql("FK_Historial_Estatus", "historial_pagos", "id_estatus_pago", "dim_estatus_pago", "id_estatus"),
            _orphan_sql("FK_Riesgo_Cliente", "riesgo_crediticio", "id_cliente", "dim_cliente", "id_cliente"),
        ]
    )
)
def fk_orphans(spark, sf_dir):
    return integrity.orphan_report(integrity.star_foreign_keys(b.star(spark, sf_dir)))


@query(
    b.HOLES_SQL
    + """SELECT 'saldo_nulo' AS regla, count(*) AS filas FROM holes WHERE c_acctbal IS NULL
  UNION ALL SELECT 'nacion_nula', count(*) FROM holes WHERE c_nationkey IS NULL
  UNION ALL SELECT 'saldo_negativo', count(*) FROM holes WHERE c_acctbal < 0"""
)
def null_range_checks(spark, sf_dir):
    rules = {
        "saldo_nulo": F.col("c_acctbal").isNull(),
        "nacion_nula": F.col("c_nationkey").isNull(),
        "saldo_negativo": F.col("c_acctbal") < 0,
    }
    return integrity.rule_report(b.customers_with_holes(spark, sf_dir), rules)


@query(
    b.STAR_SQL
    + " UNION ALL ".join(
        [f"SELECT '{c}_nulo' AS regla, count(*) - count({c}) AS filas FROM dim_cliente"
         for c in ["id_cliente", "id_sexo", "id_educacion", "id_estado_civil", "edad", "limite_credito"]]
        + ["SELECT 'edad_fuera_de_rango' AS regla, count(*) AS filas FROM dim_cliente WHERE edad < 0 OR edad > 255"]
    )
)
def client_rule_report(spark, sf_dir):
    return integrity.rule_report(b.clients(spark, sf_dir), integrity.client_rules())


def _staging_with_holes(spark, sf_dir):
    """Staging rows, some without an id and some without a target, as the nullable table allows."""
    target = STAGING_SCHEMA.names[-1]
    return b.staging(spark, sf_dir).withColumns(
        {target: F.when(F.col("ID") % 10 != 7, F.col(target)), "ID": F.when(F.col("ID") % 10 != 3, F.col("ID"))}
    )


_TARGET = STAGING_SCHEMA.names[-1]
_HOLES_SQL = b.STAR_SQL + f""", con_huecos AS (SELECT * REPLACE (CASE WHEN ID % 10 <> 3 THEN ID END AS ID,
  CASE WHEN ID % 10 <> 7 THEN {_TARGET} END AS {_TARGET}) FROM staging) """


@query(_HOLES_SQL + "SELECT * FROM con_huecos")
def csv_staging_load(spark, sf_dir):
    """Staging written as CSV with a header line per file, then loaded by content."""
    path = scratch_path(spark, "csv")
    _staging_with_holes(spark, sf_dir).write.option("header", True).csv(path)
    return csvfiles.read_staging_csv(spark, path)


@query(
    _HOLES_SQL
    + "SELECT "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in STAGING_SCHEMA.names)
    + " FROM con_huecos WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ["ID", _TARGET, *PAY_COLUMNS, *BILL_COLUMNS, *PAID_COLUMNS])
)
def csv_numeric_load(spark, sf_dir):
    """The same file as complete numeric rows."""
    path = scratch_path(spark, "csv")
    _staging_with_holes(spark, sf_dir).write.option("header", True).csv(path)
    return csvfiles.read_numeric_csv(spark, path)


@query(_HOLES_SQL + "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in STAGING_SCHEMA.names) + " FROM con_huecos")
def csv_sniffed_load(spark, sf_dir):
    """The same file with its column names taken from the first lines."""
    path = scratch_path(spark, "csv")
    _staging_with_holes(spark, sf_dir).write.option("header", True).csv(path)
    return csvfiles.read_sniffed_csv(spark, path)


_ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _stored_tables(spark, sf_dir):
    return {n: b.table(spark, sf_dir, n) for n in _ALL_TABLES}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS tabla, count(*) AS filas, CAST(1 AS BIGINT) AS archivos FROM {t}" for t in _ALL_TABLES
    )
)
def table_inventory(spark, sf_dir):
    return tables.table_inventory(_stored_tables(spark, sf_dir)).select("tabla", "filas", "archivos")


@query(
    "SELECT CAST(count(*) AS BIGINT) AS total_tablas, CAST(sum(n) AS BIGINT) AS total_filas, "
    "CAST(floor(sum(n) / count(*)) AS BIGINT) AS promedio_filas FROM ("
    + " UNION ALL ".join(
        f"SELECT count(*) AS n FROM {t}" for t in _ALL_TABLES
    )
    + ")"
)
def inventory_totals(spark, sf_dir):
    return tables.inventory_totals(tables.table_inventory(_stored_tables(spark, sf_dir))).drop("total_mb")


@query(
    b.STAR_SQL
    + "SELECT id_educacion, count(*) AS n, CAST(sum(limite_credito) AS DECIMAL(28,2)) AS total "
    "FROM vw_ml_dataset GROUP BY id_educacion"
)
def adhoc_sql(spark, sf_dir):
    """A statement over the registered views."""
    tables.register_views(b.star(spark, sf_dir), b.staging(spark, sf_dir))
    return tables.run_query(
        spark,
        "SELECT id_educacion, count(*) AS n, sum(limite_credito) AS total FROM vw_ml_dataset GROUP BY id_educacion",
    )


@query(
    b.STAR_SQL
    + """, lote AS (SELECT ID, LIMIT_BAL FROM staging ORDER BY ID LIMIT 200)
SELECT ID, LIMIT_BAL, mes_referencia, descripcion_estatus AS estado_de_pago, monto_estado_cuenta, monto_pago_anterior
FROM lote JOIN historial_pagos h ON h.id_cliente = ID JOIN dim_tiempo_mes USING (id_mes)
  JOIN dim_estatus_pago ON id_estatus = id_estatus_pago"""
)
def adhoc_procedures(spark, sf_dir):
    """A statement that calls two procedures: the next batch, and the history of each of its clients."""
    tables.register_views(b.star(spark, sf_dir), b.staging(spark, sf_dir))
    tables.register_procedures(spark)
    return tables.run_query(
        spark,
        """SELECT l.ID, l.LIMIT_BAL, h.mes_referencia, h.estado_de_pago, h.monto_estado_cuenta, h.monto_pago_anterior
           FROM lote_siguiente(200) l, LATERAL historial_cliente(l.ID) h""",
    )


@query("SELECT least(50, count(*)) AS filas FROM customer")
def table_preview(spark, sf_dir):
    """Any fifty rows; which ones is open, so their number is compared."""
    b.table(spark, sf_dir, "customer").createOrReplaceTempView("vista_previa")
    return tables.preview(spark, "vista_previa", 50).agg(F.count("*").alias("filas"))


@query(
    b.EXPERIMENTS_SQL
    + """SELECT coalesce(substr(fecha, 1, 19), 'N/A') AS fecha, coalesce(algoritmo, 'N/A') AS algoritmo,
  coalesce(n_clusters, n_estimators, 'N/A') AS tamano_modelo, coalesce(calidad, 'N/A') AS calidad,
  coalesce(inercia_f1, 'N/A') AS inercia_f1, coalesce(registros, 'N/A') AS registros,
  TRY_CAST(coalesce(n_clusters, n_estimators) AS INTEGER) AS tamano_modelo_num,
  TRY_CAST(calidad AS DOUBLE) AS calidad_num, TRY_CAST(inercia_f1 AS DOUBLE) AS inercia_f1_num,
  TRY_CAST(registros AS BIGINT) AS registros_num FROM documentos"""
)
def document_flatten(spark, sf_dir):
    docs = documents.parse_documents(b.experiment_texts(spark, sf_dir), "documento")
    return documents.flatten_documents(docs)


@query(
    b.EXPERIMENTS_SQL
    + """SELECT fecha, algoritmo, 'n_clusters' AS parametro, n_clusters AS valor FROM documentos WHERE n_clusters IS NOT NULL
  UNION ALL SELECT fecha, algoritmo, 'random_state', '42' FROM documentos WHERE n_clusters IS NOT NULL
  UNION ALL SELECT fecha, algoritmo, 'n_estimators', n_estimators FROM documentos WHERE n_estimators IS NOT NULL"""
)
def hyperparameters_exploded(spark, sf_dir):
    docs = documents.parse_documents(b.experiment_texts(spark, sf_dir), "documento")
    return documents.explode_parameters(docs)


@query(
    b.EXPERIMENTS_SQL
    + """SELECT count(*) AS total, count(*) FILTER (WHERE algoritmo = 'K-Means') AS k_means,
  count(*) FILTER (WHERE algoritmo = 'Random Forest') AS random_forest FROM documentos"""
)
def experiments_by_algorithm(spark, sf_dir):
    docs = documents.parse_documents(b.experiment_texts(spark, sf_dir), "documento")
    return documents.count_by_algorithm(docs)


@query(
    b.EXPERIMENTS_SQL
    + """SELECT fecha, n_clusters, inercia_f1 FROM documentos WHERE algoritmo = 'K-Means'
  ORDER BY fecha DESC LIMIT 10"""
)
def latest_experiments(spark, sf_dir):
    docs = documents.parse_documents(b.experiment_texts(spark, sf_dir), "documento")
    return documents.latest_documents(docs, "K-Means", 10).select(
        "fecha", F.col("hiperparametros")["n_clusters"].alias("n_clusters"), F.col("metricas")["inertia"].alias("inercia_f1")
    )


@query(
    b.EXPERIMENTS_SQL
    + """SELECT algoritmo, count(*) AS n FROM documentos GROUP BY algoritmo"""
)
def experiment_log_round_trip(spark, sf_dir):
    """Documents appended to a JSON log and read back."""
    path = scratch_path(spark, "experiments")
    documents.append_documents(documents.parse_documents(b.experiment_texts(spark, sf_dir), "documento"), path)
    return documents.read_documents(spark, path).groupBy("algoritmo").agg(F.count("*").alias("n"))


@query("SELECT 'eventos' AS coleccion, count(*) AS documentos FROM events UNION ALL SELECT 'etiquetas', count(*) FROM labels")
def documents_per_collection(spark, sf_dir):
    return documents.count_by_collection(
        {"eventos": b.table(spark, sf_dir, "events"), "etiquetas": b.table(spark, sf_dir, "labels")}
    )


def _open_orders(spark, sf_dir):
    """Orders as documents with fields that only some of them have, appended to a collection and read back."""
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.struct((F.col("o_orderkey") % 7).alias("semilla"), F.col("o_orderstatus").alias("estado")))
    amount = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
    text = F.to_json(F.struct(F.col("o_orderkey").alias("id"), odd.alias("nuevo"), amount.alias("registros")))
    path = scratch_path(spark, "documents")
    documents.append_open_documents(documents.open_documents(b.table(spark, sf_dir, "orders").select(text.alias("texto")), "texto"), path)
    return documents.read_open_documents(spark, path)


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 ELSE -1 END AS semilla,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'N/A' END AS estado,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END AS registros FROM orders"""
)
def variant_lookup(spark, sf_dir):
    """Nested look-ups with defaults and second choices in documents whose fields differ."""
    return _open_orders(spark, sf_dir).select(
        documents.lookup("documento", "$.id", kind="bigint").alias("id"),
        documents.lookup("documento", "$.nuevo.semilla", kind="bigint", default=-1).alias("semilla"),
        documents.lookup("documento", "$.nuevo.estado", default=documents.ABSENT).alias("estado"),
        documents.lookup("documento", "$.registros", "$.id", kind="bigint").alias("registros"),
    )


@query(
    """SELECT 'id' AS campo, count(*) AS documentos FROM orders
  UNION ALL SELECT 'nuevo', count(*) FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'registros', count(*) FROM orders WHERE o_orderkey % 2 = 0"""
)
def variant_fields(spark, sf_dir):
    """All fields that documents of a collection have, and in how many."""
    return documents.document_fields(_open_orders(spark, sf_dir)).select("campo", "documentos")
