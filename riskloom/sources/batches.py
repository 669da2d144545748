"""Star tables on Parquet, changed by numbered commits, each visible all or not at all.

A commit writes its folders and then one row to the log. The log row comes
last, and readers take only what logged commits name, so a job that dies
half-way leaves nothing visible; the retry overwrites its folders.

* ``lote``: a batch writes its new rows as one ``lote=<n>`` folder per table, and the last id it took from staging.
* ``baja``: a delete writes the ids as tombstones; rows of earlier commits with such an id are left out on read.
* ``vaciado``: a delete of the first staging rows moves the last id, and keeps what is left of a cut tie.
* ``compacta``: the visible rows are written anew as a base; what came before it is not read any more.

Staging is written once. A batch takes its smallest ids and all rows that have
them, so what is left is what lies beyond the last id: no list of migrated ids
is kept or joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.migration import BatchResult, delete_first_n, full_load, migrate_batch
from riskloom.operators.selection import split_first_n
from riskloom.schemas import CLIENT_SCHEMA, HISTORY_SCHEMA, STAGING_SCHEMA, TARGET_SCHEMA, CreditStar
from riskloom.session import drop_path

_SCHEMAS = {"dim_cliente": CLIENT_SCHEMA, "riesgo_crediticio": TARGET_SCHEMA, "historial_pagos": HISTORY_SCHEMA}
_NUMBER = T.StructField("lote", T.IntegerType())
_TOMBSTONES = T.StructType([T.StructField("id_cliente", T.LongType()), T.StructField("numero", T.IntegerType())])
_LOG = T.StructType(
    [
        _NUMBER,
        T.StructField("registros_solicitados", T.LongType()),
        T.StructField("registros_migrados", T.LongType()),
        T.StructField("registros_restantes_staging", T.LongType()),
        T.StructField("tipo", T.StringType()),
        T.StructField("ultimo_id", T.LongType()),
        T.StructField("resto", T.LongType()),
        T.StructField("origen", T.StringType()),
    ]
)


@dataclass(frozen=True)
class _State:
    """What the log says: newest commit, base, batches and deletes since then, how far staging is used up."""

    last: int
    base: int | None
    batches: list[int]
    deletes: list[int]
    last_id: int | None
    rest: int | None


class CreditStore:
    """The tables under one folder: ``staging`` (written once), three star tables, a log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._read("lotes", _LOG).select(*_LOG.names)

    def _state(self) -> _State:
        commits = sorted(self.log().collect(), key=lambda r: r["lote"])  # one row for each commit
        bases = [r["lote"] for r in commits if r["tipo"] == "compacta"]
        base = bases[-1] if bases else None
        since = [r for r in commits if base is None or r["lote"] > base]
        used = [r for r in commits if r["ultimo_id"] is not None]
        return _State(
            commits[-1]["lote"] if commits else 0,
            base,
            [r["lote"] for r in since if r["tipo"] == "lote"],
            [r["lote"] for r in since if r["tipo"] == "baja"],
            used[-1]["ultimo_id"] if used else None,
            used[-1]["lote"] if used and used[-1]["resto"] else None,
        )

    def _published(self, name: str, state: _State) -> DataFrame:
        rows = self._read(name, T.StructType([*_SCHEMAS[name].fields, _NUMBER])).where(F.col("lote").isin(state.batches))
        if state.base is not None:
            kept = self._read(f"base/numero={state.base}/{name}", _SCHEMAS[name])
            rows = rows.unionByName(kept.withColumn("lote", F.lit(state.base)))
        if state.deletes:
            gone = self._read("bajas", _TOMBSTONES).where(F.col("numero").isin(state.deletes))
            gone = gone.groupBy("id_cliente").agg(F.max("numero").alias("numero"))
            rows = rows.join(gone, "id_cliente", "left").where("numero is null or lote > numero").drop("numero")
        return rows.select(*_SCHEMAS[name].names)

    def star(self) -> CreditStar:
        state = self._state()
        return CreditStar(*[self._published(n, state) for n in _SCHEMAS])

    def load_staging(self, staging: DataFrame) -> None:
        staging.select(*STAGING_SCHEMA.names).write.mode("errorifexists").parquet(f"{self.root}/staging")

    def staging(self) -> DataFrame:
        """Staging rows that no commit has used up."""
        return self._staging(self._state())

    def _staging(self, state: _State) -> DataFrame:
        rows = self._read("staging", STAGING_SCHEMA)
        if state.last_id is not None:
            rows = rows.where(F.col("ID").isNull() | (F.col("ID") > F.lit(state.last_id)))
        if state.rest is not None:
            rows = rows.unionByName(self._read(f"resto/numero={state.rest}", STAGING_SCHEMA))
        return rows

    def migrate(self, n: int) -> DataFrame:
        """Run and publish one batch; returns its report row."""
        return self._migrate(n, self._state())

    def migrate_all(self) -> DataFrame:
        """Everything in staging as one batch, for the first load."""
        state = self._state()
        return self._migrate(max(1, self._staging(state).count()), state)

    def load_numbered(self, stream: str, number: int, rows: DataFrame) -> bool:
        """Publish staging rows from outside as one batch; False if that number of ``stream`` is published already.

        For jobs that may repeat a step, such as micro-batches. Rows of clients that are there are skipped.
        """
        name = f"{stream}/{number}"
        if not self.log().where(F.col("origen") == name).isEmpty() or rows.isEmpty():
            return False
        self._load(rows, rows.count(), self._state(), name)
        return True

    def _migrate(self, n: int, state: _State) -> DataFrame:
        return self._load(self._staging(state), n, state)

    def _load(self, staging: DataFrame, n: int, state: _State, source: str | None = None) -> DataFrame:
        """Publish the first ``n`` rows; those of the own staging table (no ``source``) are used up by it."""
        loaded = CreditStar(*[self._published(t, state) for t in _SCHEMAS])
        result: BatchResult = migrate_batch(staging, loaded, n)
        number = state.last + 1
        for name, rows in zip(_SCHEMAS, (result.new_clients, result.new_targets, result.new_history), strict=True):
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/lote={number}")
        used = None if source else result.batch.agg(F.max("ID")).first()[0]
        return self._commit(number, "lote", tuple(result.report.first()), used, source=source)

    def delete_clients(self, ids: DataFrame) -> DataFrame:
        """Delete clients and their child rows for a table of ids (``id_cliente``); returns the ids asked for."""
        number = self._state().last + 1
        asked = ids.select(F.col("id_cliente").cast("long")).where("id_cliente is not null").distinct()
        asked.write.mode("overwrite").parquet(f"{self.root}/bajas/numero={number}")
        self._commit(number, "baja")
        written = self.spark.read.schema("id_cliente long").parquet(f"{self.root}/bajas/numero={number}")
        return written.withColumnRenamed("id_cliente", "id_cliente_eliminado")

    def delete_first(self, n: int) -> DataFrame:
        """Delete the first ``n`` staging rows by id, as :func:`delete_first_n` does; returns its report row."""
        state = self._state()
        rows = self._staging(state)
        remaining, report = delete_first_n(rows, n)
        told = report.first()
        deleted, number = told["registros_eliminados"], state.last + 1
        if not deleted:
            return report
        used = split_first_n(rows, "ID", deleted)[0].agg(F.max("ID")).first()[0]
        tied = remaining.where(F.col("ID") == F.lit(used))
        rest = tied.count()
        if rest:
            tied.select(*STAGING_SCHEMA.names).write.mode("overwrite").parquet(f"{self.root}/resto/numero={number}")
        self._commit(number, "vaciado", tuple(told), used, rest)
        return report

    def compact(self) -> None:
        """Write the visible rows as a new base, without tombstones; earlier commits are not read any more."""
        state = self._state()
        number = state.last + 1
        for name in _SCHEMAS:
            self._published(name, state).write.mode("overwrite").parquet(f"{self.root}/base/numero={number}/{name}")
        self._commit(number, "compacta")

    def vacuum(self) -> None:
        """Remove the folders of commits before the newest base; the log stays. For when no reader uses them any more."""
        base = self._state().base
        for row in self.log().where(F.col("lote") < F.lit(base or 0)).collect():
            number, kind = row["lote"], row["tipo"]
            folders = {
                "lote": [f"{t}/lote={number}" for t in _SCHEMAS],
                "baja": [f"bajas/numero={number}"],
                "compacta": [f"base/numero={number}"],
            }
            for folder in folders.get(kind, []):
                drop_path(self.spark, f"{self.root}/{folder}")

    def _commit(
        self, number: int, kind: str, report: tuple = (None, None, None), last_id: int | None = None, rest: int = 0,
        source: str | None = None,
    ) -> DataFrame:
        row = self.spark.createDataFrame([(number, *report, kind, last_id, rest, source)], _LOG)
        try:  # one folder a commit: a second writer of the same number finds it there
            row.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/lotes/numero={number}")
        except AnalysisException as error:
            raise RuntimeError(f"commit {number} was published by another writer; run it again") from error
        return row.select(*_LOG.names[1:4])


def load_star(staging: DataFrame, root: str) -> CreditStar:
    """Full load: three tables appended under ``root``, read back."""
    star = full_load(staging)
    spark = staging.sparkSession
    out = {}
    for name, schema in [("dim_cliente", CLIENT_SCHEMA), ("riesgo_crediticio", TARGET_SCHEMA), ("historial_pagos", HISTORY_SCHEMA)]:
        getattr(star, name).write.mode("append").parquet(f"{root}/{name}")
        out[name] = spark.read.schema(schema).parquet(f"{root}/{name}")
    return CreditStar(**out)
