"""Projections, renames and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import BILL_COLUMNS, PAID_COLUMNS, PAY_COLUMNS, TARGET_NAMES

# --- fixed values: names used by the models and by the exploratory reports -----
MODEL_NAMES = {
    "id_cliente": "ID",
    "id_sexo": "SEX",
    "id_educacion": "EDUCATION",
    "id_estado_civil": "MARRIAGE",
    "edad": "AGE",
    "limite_credito": "LIMIT_BAL",
}
MODEL_TARGET = "default payment next month"
REPORT_NAMES = {
    "LIMIT_BAL": "Limite_Credito",
    "SEX": "Sexo",
    "EDUCATION": "Educacion",
    "MARRIAGE": "Estado_Civil",
    "AGE": "Edad",
    "PAY_0": "Pago_Mes_Actual",
}
REPORT_TARGET = "Incumplimiento"
REPORT_CATEGORICAL = ["Sexo", "Educacion", "Estado_Civil", "Incumplimiento"]
EDUCATION_RECODE = {0: 4, 5: 4, 6: 4}
MARITAL_RECODE = {0: 3}
# ------------------------------------------------------------------------------


def to_model_names(dataset: DataFrame) -> DataFrame:
    """The ML view under the column names the models use."""
    history = [*PAY_COLUMNS, *BILL_COLUMNS, *PAID_COLUMNS]
    return dataset.select(
        *[F.col(old).alias(new) for old, new in MODEL_NAMES.items()],
        *history,
        F.col("target").alias(MODEL_TARGET),
    )


def find_target(columns: Sequence[str]) -> str:
    """The first known target name present, else the last column."""
    return next((name for name in TARGET_NAMES if name in columns), columns[-1])


def report_names(columns: Sequence[str]) -> dict[str, str]:
    """Old name -> report name for a wide client table."""
    names = dict(REPORT_NAMES)
    names |= {f"PAY_{m}": f"Pago_Mes_{m}" for m in range(2, 7)}
    names |= {f"BILL_AMT{m}": f"Factura_Mes_{m}" for m in range(1, 7)}
    names |= {f"PAY_AMT{m}": f"Pago_Anterior_{m}" for m in range(1, 7)}
    names[find_target(columns)] = REPORT_TARGET
    return names


def to_report_names(df: DataFrame) -> DataFrame:
    """Rename to report names; columns without one keep theirs."""
    return df.withColumnsRenamed(report_names(df.columns))


def drop_present(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns, ignoring absent ones."""
    return df.drop(*columns)


def recode(df: DataFrame, column: str, mapping: Mapping[int, int]) -> DataFrame:
    """Replace listed values, keep all others."""
    return df.replace(dict(mapping), subset=[column])


def recode_categories(df: DataFrame, education: str = "Educacion", marital: str = "Estado_Civil") -> DataFrame:
    """Fold the undocumented education and marital codes into "other"."""
    return recode(recode(df, education, EDUCATION_RECODE), marital, MARITAL_RECODE)


def split_columns(df: DataFrame, categorical: Sequence[str] = REPORT_CATEGORICAL) -> tuple[list[str], list[str]]:
    """(numeric, categorical): by list for the latter, the remaining columns are numeric."""
    return [c for c in df.columns if c not in categorical], [c for c in df.columns if c in categorical]


def class_facts(df: DataFrame, categorical: Sequence[str] = REPORT_CATEGORICAL) -> DataFrame:
    """(columna, clase, distintos, minimo, maximo) of numeric columns, in one row of aggregates."""
    numbers, categories = split_columns(df, categorical)
    classes = dict.fromkeys(numbers, "numerica") | dict.fromkeys(categories, "categorica")
    facts = df.agg(
        *[F.struct(F.countDistinct(c).alias("n"), F.min(c).cast("double").alias("a"), F.max(c).cast("double").alias("z")).alias(c) for c in classes]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("columna"), F.lit(k).alias("clase"), F.col(f"`{c}`").alias("f")) for c, k in classes.items()]
    )
    rows = facts.select(F.explode(cells).alias("r"))
    return rows.select("r.columna", "r.clase", F.col("r.f.n").alias("distintos"), F.col("r.f.a").alias("minimo"), F.col("r.f.z").alias("maximo"))


def nan_as_null(df: DataFrame) -> DataFrame:
    """Float and double columns with NaN as NULL, as both mean a missing number."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in floating}) if floating else df


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def when_given(df: DataFrame, column: str, value: Any, everything: str = "Todas") -> DataFrame:
    """Filter by ``value``, or not at all for ``None`` / the "all" choice."""
    if value is None or value == everything:
        return df
    return df.where(F.col(column) == F.lit(value))


def in_list(column: str, values: Sequence[Any], negate: bool = False) -> Column:
    """``IN`` / ``NOT IN`` a literal list; a NULL operand gives NULL in both."""
    found = F.col(column).isin(list(values))
    return ~found if negate else found


def since_start_of_day(column: str, now: datetime) -> Column:
    """Rows not older than the start of the day of ``now``."""
    moment = F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.col(column) >= F.date_trunc("day", moment)


def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def exists_flag(df: DataFrame, condition: Column) -> DataFrame:
    """One row: 1 if any row satisfies ``condition``, else 0. The condition reaches the scan, and one row is enough."""
    return df.where(condition).limit(1).agg(F.count("*").cast("int").alias("existe"))


def at_threshold(probability: Column, threshold: float) -> Column:
    """1 where ``probability >= threshold``, else 0."""
    return (probability >= F.lit(float(threshold))).cast("int")


def require_positive(n: int | None) -> int:
    """A usable batch size, or an error before anything is written."""
    if n is None or isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError("the number of rows must be greater than zero")
    return n


def scatter_points(df: DataFrame, x: str, y: str, colour: str) -> DataFrame:
    """The three columns of a coloured scatter plot, all rows."""
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(colour).alias("clase"))
