"""The change log of the target table and the summaries read from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import bit_text
from riskloom.operators.filters import since_start_of_day, when_given
from riskloom.operators.selection import top_rows


def audit_rows(
    changes: DataFrame,
    table: str = "riesgo_crediticio",
    user: Column | None = None,
    at: Column | None = None,
) -> DataFrame:
    """Change-log rows from (``key``, ``before``, ``after``) rows.

    Flags ``was`` and ``is`` say on which sides the key is; without them, NULL
    on one side tells inserts from deletes. A projection, so it serves batch and
    streaming frames alike.
    """
    flagged = {"was", "is"} <= set(changes.columns)
    was = F.col("was") if flagged else F.col("before").isNotNull()
    now = F.col("is") if flagged else F.col("after").isNotNull()
    operation = F.when(~was, "I").when(~now, "D").otherwise("U")
    return changes.where(was | now).select(
        F.lit(table).alias("tabla_afectada"),
        operation.alias("operacion"),
        F.col("key").cast("long").alias("id_registro_afectado"),
        (F.current_user() if user is None else user).alias("usuario"),
        (F.current_timestamp() if at is None else at).alias("fecha_cambio"),
        bit_text("before").alias("datos_antes"),
        bit_text("after").alias("datos_despues"),
    )


def snapshot_changes(
    before: DataFrame, after: DataFrame, key: str, value: str, include_unchanged: bool = False
) -> DataFrame:
    """(``key``, ``before``, ``after``, ``was``, ``is``) rows between two snapshots with unique keys.

    Both sides are stacked and grouped by key: one shuffle, combined map-side.
    ``include_unchanged`` also reports keys present in both with equal values,
    as an update that sets the same value would.
    """
    nothing = F.lit(None).cast(before.schema[value].dataType)
    old = before.select(F.col(key).alias("key"), F.col(value).alias("before"), nothing.alias("after"), F.lit(True).alias("was"), F.lit(False).alias("is"))
    new = after.select(F.col(key).alias("key"), nothing.alias("before"), F.col(value).alias("after"), F.lit(False).alias("was"), F.lit(True).alias("is"))
    sides = old.unionByName(new).groupBy("key").agg(
        F.max("before").alias("before"), F.max("after").alias("after"), F.max("was").alias("was"), F.max("is").alias("is")
    )
    if include_unchanged:
        return sides
    return sides.where((F.col("was") != F.col("is")) | ~F.col("before").eqNullSafe(F.col("after")))


def with_audit_id(log: DataFrame) -> DataFrame:
    """A repeatable id from the content of each change."""
    key = F.xxhash64("tabla_afectada", "operacion", "id_registro_afectado", "fecha_cambio")
    return log.select(key.alias("id_auditoria"), "*")


def audit_summary(log: DataFrame) -> DataFrame:
    """Total, inserts, updates, deletes and the latest change."""
    return log.agg(
        F.count("*").alias("total"),
        *[
            F.count_if(F.col("operacion") == op).alias(name)
            for op, name in [("I", "inserts"), ("U", "updates"), ("D", "deletes")]
        ],
        F.max("fecha_cambio").alias("ultimo"),
    )


def latest_changes(log: DataFrame, operation: str | None = None, n: int = 50) -> DataFrame:
    """The newest ``n`` changes, of one operation if given."""
    chosen = when_given(log, "operacion", operation)
    return top_rows(chosen, [F.col("fecha_cambio").desc(), F.col("id_auditoria").desc()], n)


def latest_jobs(history: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` job-history rows under their display names."""
    return top_rows(history, [F.col("backup_date").desc(), F.col("id").desc()], n).select(
        "id",
        F.col("backup_type").alias("tipo"),
        F.col("backup_path").alias("ruta"),
        F.col("backup_date").alias("fecha"),
        F.col("file_size_mb").alias("tamano_mb"),
        F.col("status").alias("estado"),
        "usuario",
        "notas",
    )


def job_kpis(history: DataFrame, now: datetime, n: int = 50) -> DataFrame:
    """Count, today's count, total size and latest time over the newest ``n`` rows."""
    newest = latest_jobs(history, n)
    return newest.agg(
        F.count("*").alias("total"),
        F.count_if(since_start_of_day("fecha", now)).alias("hoy"),
        F.coalesce(F.sum("tamano_mb").cast("double"), F.lit(0.0)).alias("espacio_total_mb"),
        F.coalesce(F.date_format(F.max("fecha"), "yyyy-MM-dd HH:mm"), F.lit("N/A")).alias("ultimo"),
    )


def schedule_listing(schedules: DataFrame) -> DataFrame:
    """Schedules, active first, then by name."""
    return schedules.orderBy(F.col("enabled").desc(), F.col("schedule_name").asc(), F.col("id").asc()).select(
        "id",
        F.col("schedule_name").alias("nombre"),
        F.col("backup_type").alias("tipo"),
        F.col("frequency").alias("frecuencia"),
        F.col("time_of_day").alias("hora"),
        F.when(F.col("enabled") == 1, "Activo").otherwise("Inactivo").alias("estado"),
        F.col("last_run").alias("ultima_ejecucion"),
        F.col("next_run").alias("proxima_ejecucion"),
    )
