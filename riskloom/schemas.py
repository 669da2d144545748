"""Schemas of the credit data, its catalogs and its logs."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MONEY = T.DecimalType(18, 2)

# --- fixed values: column names of the wide client table ---------------------
PAY_COLUMNS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILL_COLUMNS = ["BILL_AMT1", "BILL_AMT2", "BILL_AMT3", "BILL_AMT4", "BILL_AMT5", "BILL_AMT6"]
PAID_COLUMNS = ["PAY_AMT1", "PAY_AMT2", "PAY_AMT3", "PAY_AMT4", "PAY_AMT5", "PAY_AMT6"]
TARGET_COLUMN = "default_payment_next_month"
TARGET_NAMES = ["default payment next month", "default_payment_next_month", "Y", "default"]
# -----------------------------------------------------------------------------

#: month number -> (status, bill, payment) columns; month 1 is the newest
MONTH_COLUMNS = list(enumerate(zip(PAY_COLUMNS, BILL_COLUMNS, PAID_COLUMNS), start=1))


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


# Client ids are BIGINT rather than INT so that they cannot run out.
STAGING_SCHEMA = T.StructType(
    _fields(["ID"], T.LongType())
    + _fields(["LIMIT_BAL"], MONEY)
    + _fields(["SEX", "EDUCATION", "MARRIAGE", "AGE", *PAY_COLUMNS], T.IntegerType())
    + _fields(BILL_COLUMNS + PAID_COLUMNS, MONEY)
    + _fields([TARGET_COLUMN], T.IntegerType())
)

CLIENT_SCHEMA = T.StructType(
    [
        T.StructField("id_cliente", T.LongType()),
        T.StructField("id_sexo", T.IntegerType()),
        T.StructField("id_educacion", T.IntegerType()),
        T.StructField("id_estado_civil", T.IntegerType()),
        T.StructField("edad", T.ShortType()),
        T.StructField("limite_credito", MONEY),
    ]
)

TARGET_SCHEMA = T.StructType(
    [
        T.StructField("id_cliente", T.LongType()),
        T.StructField("incumplimiento_proximo_mes", T.IntegerType()),
    ]
)

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("id_cliente", T.LongType()),
        T.StructField("id_mes", T.IntegerType()),
        T.StructField("id_estatus_pago", T.IntegerType()),
        T.StructField("monto_estado_cuenta", MONEY),
        T.StructField("monto_pago_anterior", MONEY),
    ]
)

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("tabla_afectada", T.StringType()),
        T.StructField("operacion", T.StringType()),
        T.StructField("id_registro_afectado", T.LongType()),
        T.StructField("usuario", T.StringType()),
        T.StructField("fecha_cambio", T.TimestampType()),
        T.StructField("datos_antes", T.StringType()),
        T.StructField("datos_despues", T.StringType()),
    ]
)

EXPERIMENT_SCHEMA = T.StructType(
    [
        T.StructField("fecha", T.StringType()),
        T.StructField("algoritmo", T.StringType()),
        T.StructField("hiperparametros", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metricas", T.MapType(T.StringType(), T.StringType())),
    ]
)

# --- fixed values: catalog rows ----------------------------------------------
SEX_ROWS = [(1, "Masculino"), (2, "Femenino")]
EDUCATION_ROWS = [
    (0, "Sin Instruccion"),
    (1, "Posgrado"),
    (2, "Universidad"),
    (3, "Bachillerato"),
    (4, "Otros"),
    (5, "Desconocido"),
    (6, "Desconocido"),
]
MARITAL_ROWS = [(0, "Desconocido"), (1, "Casado"), (2, "Soltero"), (3, "Otros")]
MONTH_ROWS = [
    (1, "Mes 1 (Septiembre, 2005)", 1),
    (2, "Mes 2 (Agosto, 2005)", 2),
    (3, "Mes 3 (Julio, 2005)", 3),
    (4, "Mes 4 (Junio, 2005)", 4),
    (5, "Mes 5 (Mayo, 2005)", 5),
    (6, "Mes 6 (Abril, 2005)", 6),
]
STATUS_ROWS = [
    (-2, "Sin consumo / Inactivo"),
    (-1, "Pago puntual (Duly)"),
    (0, "Pago mínimo realizado / Crédito revolvente"),
    (1, "Retraso de 1 mes"),
    (2, "Retraso de 2 meses"),
    (3, "Retraso de 3 meses"),
    (4, "Retraso de 4 meses"),
    (5, "Retraso de 5 meses"),
    (6, "Retraso de 6 meses"),
    (7, "Retraso de 7 meses"),
    (8, "Retraso de 8 meses"),
    (9, "Retraso de 9 meses o más"),
]
# -----------------------------------------------------------------------------

_CATALOGS = {
    "dim_sexo": ("id_sexo int, descripcion_sexo string", SEX_ROWS),
    "dim_educacion": ("id_educacion int, nivel_educativo string", EDUCATION_ROWS),
    "dim_estado_civil": ("id_estado_civil int, descripcion_estado_civil string", MARITAL_ROWS),
    "dim_tiempo_mes": ("id_mes int, mes_referencia string, orden_historial int", MONTH_ROWS),
    "dim_estatus_pago": ("id_estatus int, descripcion_estatus string", STATUS_ROWS),
}


def catalog(spark: SparkSession, name: str) -> DataFrame:
    """One of the five fixed catalogs (12 rows at most, so always safe to broadcast)."""
    schema, rows = _CATALOGS[name]
    columns = T.StructType.fromDDL(schema)
    cells = [pa.array(values, to_arrow_type(f.dataType)) for values, f in zip(zip(*rows), columns.fields)]
    return spark.createDataFrame(pa.table(cells, names=columns.names), columns)


@dataclass(frozen=True)
class CreditStar:
    """The three loaded tables of the star schema; the catalogs are fixed."""

    dim_cliente: DataFrame
    riesgo_crediticio: DataFrame
    historial_pagos: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.dim_cliente.sparkSession

    def catalog(self, name: str) -> DataFrame:
        return catalog(self.spark, name)
