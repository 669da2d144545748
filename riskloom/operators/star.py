"""Views and dashboard aggregates over the credit star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.reshape import counts_side_by_side, pivot_history
from riskloom.operators.selection import top_rows
from riskloom.schemas import BILL_COLUMNS, PAID_COLUMNS, PAY_COLUMNS, CreditStar


def ml_dataset(star: CreditStar) -> DataFrame:
    """``vw_ml_dataset``: client, pivoted history and target, 25 columns.

    Clients without history or without target drop out. The pivot leaves its
    rows partitioned by client, so the joins reuse that shuffle.
    """
    wide = pivot_history(star.historial_pagos)
    target = star.riesgo_crediticio.select(
        "id_cliente", F.col("incumplimiento_proximo_mes").alias("target")
    )
    return (
        star.dim_cliente.join(wide, "id_cliente")
        .join(target, "id_cliente")
        .select(
            "id_cliente", "id_sexo", "id_educacion", "id_estado_civil", "edad", "limite_credito",
            *PAY_COLUMNS, *BILL_COLUMNS, *PAID_COLUMNS, "target",
        )
    )


_LABELS = {"dim_sexo": "id_sexo", "dim_educacion": "id_educacion", "dim_estado_civil": "id_estado_civil"}


def _labelled(star: CreditStar, clients: DataFrame) -> DataFrame:
    for catalog, key in _LABELS.items():
        clients = clients.join(F.broadcast(star.catalog(catalog)), key)
    return clients


def _with_labels(star: CreditStar) -> DataFrame:
    """Clients with target, then their labels, so that no text travels through the shuffle."""
    return _labelled(star, star.dim_cliente.join(star.riesgo_crediticio, "id_cliente"))


def client_detail(star: CreditStar) -> DataFrame:
    """``vw_cliente_detallado``: clients with catalog labels and target."""
    return _with_labels(star).select(
        "id_cliente",
        F.col("descripcion_sexo").alias("sexo"),
        F.col("nivel_educativo").alias("educacion"),
        F.col("descripcion_estado_civil").alias("estado_civil"),
        "edad",
        "limite_credito",
        F.col("incumplimiento_proximo_mes").alias("target"),
    )


#: Clients looked at for each one wanted, to begin with.
_AHEAD = 8


def first_clients(star: CreditStar, n: int = 10) -> DataFrame:
    """The first ``n`` clients by id among those with labels and target.

    The smallest ids are joined with the targets up to the same id, and more of them while too few have a target: two
    narrow scans with pushed ranges instead of a join of all clients.
    """
    known = star.dim_cliente.where(F.col("id_cliente").isNotNull())
    for catalog, key in _LABELS.items():
        known = known.join(F.broadcast(star.catalog(catalog).select(key)), key, "left_semi")
    wide = _AHEAD * n
    while True:
        ids = known.select("id_cliente").orderBy("id_cliente").limit(wide)
        seen = ids.agg(F.count("*").alias("n"), F.max("id_cliente").alias("last")).first()
        upto = F.col("id_cliente") <= F.lit(seen["last"])
        near = known.where(upto).join(star.riesgo_crediticio.where(upto), "id_cliente")
        first = top_rows(near, [F.col("id_cliente")], n)
        rows = first.toArrow()  # at most n
        if rows.num_rows >= n or seen["n"] < wide:
            break
        wide *= _AHEAD
    labelled = _labelled(star, star.dim_cliente.sparkSession.createDataFrame(rows, first.schema)).select(
        "id_cliente", "descripcion_sexo", "nivel_educativo", "descripcion_estado_civil",
        "edad", "limite_credito", "incumplimiento_proximo_mes",
    )
    return top_rows(labelled, [F.col("id_cliente")], n)


def client_history(star: CreditStar, client_id: int) -> DataFrame:
    """Month-by-month history of one client, newest month first."""
    return (
        star.historial_pagos.where(F.col("id_cliente") == F.lit(client_id))
        .join(F.broadcast(star.catalog("dim_tiempo_mes")), "id_mes")
        .join(
            F.broadcast(star.catalog("dim_estatus_pago")),
            F.col("id_estatus_pago") == F.col("id_estatus"),
        )
        .orderBy("orden_historial", "id_estatus_pago", "monto_estado_cuenta")
        .select(
            "id_cliente", "mes_referencia", F.col("descripcion_estatus").alias("estado_de_pago"),
            "monto_estado_cuenta", "monto_pago_anterior",
        )
    )


def client_kpis(star: CreditStar, truncate_int_avg: bool = False) -> DataFrame:
    """Clients, mean limit, mean age and default rate (%) over client ⋈ target.

    Both sides are summed per client before the join, so a repeated id travels
    as one row and counting clients needs no second shuffle. No rows give NULL
    rates instead of an error.
    """
    people = star.dim_cliente.groupBy("id_cliente").agg(
        F.count("*").alias("rows"), F.sum("limite_credito").alias("limit"), F.sum("edad").alias("age")
    )
    target = star.riesgo_crediticio.groupBy("id_cliente").agg(
        F.count("*").alias("times"), F.sum(F.col("incumplimiento_proximo_mes").cast("int")).alias("positives")
    )
    times = F.col("times")
    joined = F.sum(F.col("rows") * times)
    mean_age = F.try_divide(F.sum(F.col("age") * times).cast("double"), joined)
    if truncate_int_avg:
        mean_age = mean_age.cast("long")
    return people.join(target, "id_cliente").agg(
        F.count("*").alias("total"),
        F.try_divide(F.sum(F.col("limit") * times).cast("double"), joined).alias("avg_limite"),
        mean_age.alias("avg_edad"),
        F.try_divide(F.sum(F.col("positives") * F.col("rows")) * F.lit(100.0), joined).alias("tasa"),
    )


def count_by_label(facts: DataFrame, key: str, catalog: DataFrame, catalog_key: str, label: str) -> DataFrame:
    """Count facts by catalog *label*: ids that share a label merge.

    Facts are counted by id before they meet the catalog, so the join sees one
    row per id.
    """
    per_id = facts.groupBy(F.col(key).alias(catalog_key)).agg(F.count("*").alias("__c"))
    return (
        per_id.join(F.broadcast(catalog.select(catalog_key, label)), catalog_key)
        .groupBy(label)
        .agg(F.sum("__c").alias("cantidad"))
    )


def age_by_sex(star: CreditStar) -> DataFrame:
    """(sex label, age) rows, the input of the age box plot."""
    return star.dim_cliente.join(F.broadcast(star.catalog("dim_sexo")), "id_sexo").select(
        "descripcion_sexo", "edad"
    )


def migration_summary(staging: DataFrame, star: CreditStar) -> DataFrame:
    """Row counts of staging and the three tables; pending = staging."""
    counts = counts_side_by_side(
        {
            "total_staging": staging,
            "total_clientes": star.dim_cliente,
            "total_riesgo": star.riesgo_crediticio,
            "total_historial": star.historial_pagos,
        }
    )
    return counts.withColumn("pendientes_por_migrar", F.col("total_staging"))


def reconcile(star: CreditStar) -> DataFrame:
    """Table counts, the expected history (six per client) and whether they agree."""
    counts = counts_side_by_side(
        {
            "total_clientes": star.dim_cliente,
            "total_target_riesgo": star.riesgo_crediticio,
            "total_registros_historial": star.historial_pagos,
        }
    )
    expected = F.col("total_clientes") * 6
    return counts.withColumn("total_historial_esperado", expected).withColumn(
        "concilia", (F.col("total_registros_historial") == expected).cast("int")
    )
