from datetime import datetime
from decimal import Decimal

from helpers import values
from pyspark.sql import functions as F

from riskloom.operators import audit
from riskloom.schemas import AUDIT_SCHEMA
from riskloom.session import scratch_path
from riskloom.streaming import change_log


def snapshot(spark, pairs):
    return spark.createDataFrame(list(pairs.items()), "id long, v int").repartition(2)


def test_snapshot_changes(spark):
    before, after = snapshot(spark, {1: 0, 2: 1, 3: 0}), snapshot(spark, {1: 0, 2: 0, 4: 1})
    log = audit.audit_rows(audit.snapshot_changes(before, after, "id", "v"))
    rows = {(r["operacion"], r["id_registro_afectado"], r["datos_antes"], r["datos_despues"]) for r in log.collect()}
    assert rows == {("U", 2, "1", "0"), ("D", 3, "0", None), ("I", 4, None, "1")}
    every = audit.audit_rows(audit.snapshot_changes(before, after, "id", "v", include_unchanged=True))
    assert every.where("id_registro_afectado = 1 and operacion = 'U' and datos_antes = '0'").count() == 1
    assert audit.snapshot_changes(before, before, "id", "v").count() == 0


def test_empty_summary(spark):
    row = audit.audit_summary(spark.createDataFrame([], AUDIT_SCHEMA)).first()
    assert tuple(row) == (0, 0, 0, 0, None)


def test_job_kpis_look_at_the_newest_only(spark):
    rows = [
        (i, "Full", "/p", datetime(2024, 1, 1 + i // 24, i % 24), Decimal("5.00") if i < 10 else None, "ok", "u", None)
        for i in range(60)
    ]
    jobs = spark.createDataFrame(
        rows, "id int, backup_type string, backup_path string, backup_date timestamp, "
        "file_size_mb decimal(10,2), status string, usuario string, notas string",
    ).repartition(4)
    row = audit.job_kpis(jobs, datetime(2024, 1, 3, 20)).first()
    assert (row["total"], row["espacio_total_mb"], row["hoy"], row["ultimo"]) == (50, 0.0, 12, "2024-01-03 11:00")
    none = audit.job_kpis(jobs.where("false"), datetime(2024, 1, 3)).first()
    assert (none["total"], none["ultimo"]) == (0, "N/A")


def test_filter_and_ids(spark):
    log = audit.with_audit_id(
        spark.createDataFrame(
            [("t", op, i, "u", datetime(2024, 1, i), None, None) for i, op in enumerate("IUDI", 1)], AUDIT_SCHEMA
        )
    )
    assert log.select("id_auditoria").distinct().count() == 4
    assert [r["id_registro_afectado"] for r in audit.latest_changes(log, "I", 5).collect()] == [4, 1]
    assert audit.latest_changes(log, None, 3).count() == 3


def test_stream_of_changes(spark):
    source, out, mark = (scratch_path(spark, n) for n in ("changes", "log", "mark"))

    def arrive(rows):
        spark.createDataFrame(rows, change_log.CHANGE_SCHEMA).write.mode("append").json(source)

    def run():
        query = change_log.write_change_log(change_log.read_changes(spark, source), out, mark)
        query.awaitTermination(60)

    t = datetime(2024, 1, 1)
    arrive([(1, None, 1, "ana", t), (2, 0, 1, "ana", t)])
    run()
    arrive([(2, 1, None, "luis", t)])
    run()
    run()  # nothing new: nothing written twice
    got = values(
        spark.read.parquet(out).withColumn("a", F.coalesce("datos_antes", F.lit("-"))).withColumn(
            "d", F.coalesce("datos_despues", F.lit("-"))
        ),
        "operacion", "id_registro_afectado", "a", "d", "usuario",
    )
    assert got == [("D", 2, "1", "-", "luis"), ("I", 1, "-", "1", "ana"), ("U", 2, "0", "1", "ana")]


def test_null_values_are_no_absence(spark):
    before = spark.createDataFrame([(1, None), (2, 1), (3, None), (4, 0)], "k long, v int")
    after = spark.createDataFrame([(1, 1), (2, None), (3, None), (5, None)], "k long, v int")
    found = audit.audit_rows(audit.snapshot_changes(before, after, "k", "v"))
    rows = {r["id_registro_afectado"]: (r["operacion"], r["datos_antes"], r["datos_despues"]) for r in found.collect()}
    assert rows == {1: ("U", None, "1"), 2: ("U", "1", None), 4: ("D", "0", None), 5: ("I", None, None)}
