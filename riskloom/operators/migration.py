"""Loading staging rows into the star schema: all at once or batch by batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.filters import require_positive
from riskloom.operators.integrity import client_rules, history_rules, key_violations, target_rules
from riskloom.operators.keyfilter import KeyFilter, key_filter
from riskloom.operators.reshape import unpivot_history
from riskloom.operators.selection import split_first_n, top_rows
from riskloom.schemas import (
    EDUCATION_ROWS,
    MARITAL_ROWS,
    MONTH_ROWS,
    SEX_ROWS,
    STATUS_ROWS,
    TARGET_COLUMN,
    CreditStar,
)
from riskloom.session import materialize

#: Rows of a batch that one task handles.
TASK_ROWS = 100_000


def clients_from(staging: DataFrame) -> DataFrame:
    """Client rows of staging rows."""
    return staging.select(
        F.col("ID").alias("id_cliente"),
        F.col("SEX").alias("id_sexo"),
        F.col("EDUCATION").alias("id_educacion"),
        F.col("MARRIAGE").alias("id_estado_civil"),
        F.col("AGE").cast("smallint").alias("edad"),
        F.col("LIMIT_BAL").alias("limite_credito"),
    )


def targets_from(staging: DataFrame) -> DataFrame:
    """Target rows of staging rows."""
    return staging.select(
        F.col("ID").alias("id_cliente"), F.col(TARGET_COLUMN).cast("int").alias("incumplimiento_proximo_mes")
    )


def full_load(staging: DataFrame) -> CreditStar:
    """Every staging row into the three tables."""
    return CreditStar(clients_from(staging), targets_from(staging), unpivot_history(staging))


def preview_batch(staging: DataFrame, n: int = 10) -> DataFrame:
    """The next ``n`` staging rows by id, nothing changed."""
    return top_rows(staging, [F.col("ID").asc_nulls_first()], n)


def new_rows(
    candidates: DataFrame, existing: DataFrame, keys: list[str], known: KeyFilter | None = None
) -> DataFrame:
    """Candidates whose key is not in ``existing``; a NULL key never matches.

    ``known`` is a filter of the candidates' first key: with it, only rows of ``existing`` that may match are shuffled.
    """
    held = existing if known is None else existing.where(known.passes(keys[0]))
    return candidates.join(held.select(*keys).distinct(), keys, "left_anti")


def without_ids(df: DataFrame, key: str, ids: DataFrame, ids_key: str, known: KeyFilter | None = None) -> DataFrame:
    """Rows whose key is not among ``ids``; rows with a NULL key stay. ``known`` is a filter of the keys of ``df``."""
    held = ids if known is None else ids.where(known.passes(ids_key))
    return df.join(held.select(F.col(ids_key).alias(key)).distinct(), key, "left_anti")


@dataclass(frozen=True)
class BatchPlan:
    """The rows of one batch (written once), the rows it leaves, and its report. Nothing else is written for these."""

    batch: DataFrame
    staging: DataFrame
    report: DataFrame


@dataclass(frozen=True)
class BatchResult(BatchPlan):
    """What one batch adds and what it leaves."""

    new_clients: DataFrame
    new_targets: DataFrame
    new_history: DataFrame

    def applied_to(self, star: CreditStar) -> CreditStar:
        return CreditStar(
            star.dim_cliente.unionByName(self.new_clients),
            star.riesgo_crediticio.unionByName(self.new_targets),
            star.historial_pagos.unionByName(self.new_history),
        )


def check_new_rows(unseen: DataFrame, new_targets: DataFrame, new_history: DataFrame) -> None:
    """Raise if the rows a batch would insert break a key, a NOT NULL, a range or a reference.

    ``unseen`` are the staging rows of new clients. Catalog ids are literals
    here, so every row rule is one filter; repeated ids are one grouped count.
    Only the totals reach the driver.
    """
    known = {
        "id_sexo": [r[0] for r in SEX_ROWS],
        "id_educacion": [r[0] for r in EDUCATION_ROWS],
        "id_estado_civil": [r[0] for r in MARITAL_ROWS],
        "id_mes": [r[0] for r in MONTH_ROWS],
        "id_estatus_pago": [r[0] for r in STATUS_ROWS],
    }

    def unknown(*columns: str) -> dict:
        return {f"{c}_sin_catalogo": ~F.col(c).isin(known[c]) for c in columns}

    clients = unseen.select(
        F.col("ID").alias("id_cliente"), F.col("SEX").alias("id_sexo"), F.col("EDUCATION").alias("id_educacion"),
        F.col("MARRIAGE").alias("id_estado_civil"), F.col("AGE").alias("edad"), F.col("LIMIT_BAL").alias("limite_credito"),
    )
    checks = [
        (clients, client_rules() | unknown("id_sexo", "id_educacion", "id_estado_civil")),
        (new_targets, target_rules()),
        (new_history, history_rules() | unknown("id_mes", "id_estatus_pago")),
    ]
    broken: dict[str, int] = {}
    for frame, rules in checks:
        counts = frame.agg(
            *[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
        ).first()
        broken |= {name: counts[name] for name in rules if counts[name]}
    keys = clients.select("id_cliente", F.lit("c").alias("t")).unionByName(
        new_targets.select("id_cliente", F.lit("r").alias("t"))
    )
    repeated = key_violations(keys, ["t", "id_cliente"]).agg(F.countDistinct("id_cliente").alias("c")).first()["c"]
    if repeated:
        broken["ID_repetido"] = repeated
    if broken:
        raise ValueError(f"batch rejected, nothing written: {broken}")


def plan_batch(staging: DataFrame, n: int) -> BatchPlan:
    """The next ``n`` staging rows (by id), what they leave, and the report.

    The batch is chosen and written once; all else is derived from it. It
    leaves staging whole, also rows that will be skipped, and the report counts
    the batch, not the inserts.
    """
    require_positive(n)
    sizes = staging.agg(F.count("*").alias("rows"), F.count("ID").alias("keyed")).first()
    if sizes["rows"] == 0:
        raise ValueError("no rows in staging")
    if sizes["keyed"] < sizes["rows"]:
        raise ValueError("batch rejected, nothing written: staging rows without ID come first")
    batch = split_first_n(staging, "ID", n, sizes["keyed"])[0]
    parts = -(-min(n, sizes["keyed"]) // TASK_ROWS)
    batch = materialize(batch.repartition(parts) if parts > 1 else batch, "lote")  # one large file is one task
    facts = batch.agg(F.count("*").alias("rows"), F.max("ID").alias("last")).first()
    # all smaller ids are in the batch, so the rows it takes along are those up to its last id
    remaining = staging.where(F.col("ID") > F.lit(facts["last"]))
    report = remaining.agg(
        F.lit(n).cast("long").alias("registros_solicitados"),
        F.lit(facts["rows"]).alias("registros_migrados"),
        F.count("*").alias("registros_restantes_staging"),
    )
    return BatchPlan(batch, remaining, report)


def migrate_batch(staging: DataFrame, star: CreditStar, n: int) -> BatchResult:
    """Move the next ``n`` staging rows (by id) into the three tables.

    Clients and targets already loaded are skipped; history is skipped only
    where (client, month, status) is already there. The rows to insert are kept
    in the shared folder, so the comparison with the loaded tables runs once,
    and are checked before they are returned. A key filter of the batch goes
    into the scans of the loaded tables, so the shuffled rows follow the batch.
    """
    plan = plan_batch(staging, n)
    known = key_filter(plan.batch, "ID")
    unseen = materialize(without_ids(plan.batch, "ID", star.dim_cliente, "id_cliente", known), "lote")
    new_targets = materialize(new_rows(targets_from(plan.batch), star.riesgo_crediticio, ["id_cliente"], known), "lote")
    months = ["id_cliente", "id_mes", "id_estatus_pago"]
    new_history = materialize(new_rows(unpivot_history(plan.batch), star.historial_pagos, months, known), "lote")
    check_new_rows(unseen, new_targets, new_history)
    return BatchResult(plan.batch, plan.staging, plan.report, clients_from(unseen), new_targets, new_history)


def delete_first_n(staging: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Delete the first ``n`` staging rows by id; returns (remaining, report).

    NULL ids sort first and use up places but match no id, so they are never
    deleted. Rows that tie on the last id go in whole-row order.
    """
    require_positive(n)
    sizes = staging.agg(F.count("*").alias("rows"), F.count("ID").alias("keyed")).first()
    total, nulls = sizes["rows"], sizes["rows"] - sizes["keyed"]
    keyed = staging.where(F.col("ID").isNotNull())
    places = n - nulls
    deleted, remaining = 0, staging
    if places > 0 and total > nulls:
        chosen, _ = split_first_n(keyed, "ID", places, sizes["keyed"])
        last = chosen.agg(F.max("ID")).first()[0]
        matching = keyed.where(F.col("ID") <= F.lit(last)).count()
        deleted = min(n, matching)
        _, remaining = split_first_n(staging, "ID", deleted, sizes["keyed"])
    report = staging.sparkSession.createDataFrame(
        [(n, deleted, total - deleted)],
        "registros_solicitados long, registros_eliminados long, registros_restantes_staging long",
    )
    return remaining, report


def delete_clients(star: CreditStar, ids: DataFrame) -> tuple[CreditStar, DataFrame]:
    """Delete clients and their child rows for a table of ids (column ``id_cliente``).

    Returns the new tables and the requested ids, present or not.
    """
    gone = CreditStar(
        without_ids(star.dim_cliente, "id_cliente", ids, "id_cliente"),
        without_ids(star.riesgo_crediticio, "id_cliente", ids, "id_cliente"),
        without_ids(star.historial_pagos, "id_cliente", ids, "id_cliente"),
    )
    return gone, ids.select(F.col("id_cliente").alias("id_cliente_eliminado")).distinct()
