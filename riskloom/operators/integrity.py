"""Primary keys, foreign keys, NOT NULL and ranges as reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.schemas import CreditStar


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("filas")).where("filas > 1")


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: DataFrame
    child_key: str
    parent: DataFrame
    parent_key: str
    parent_is_catalog: bool = False


def star_foreign_keys(star: CreditStar) -> list[ForeignKey]:
    """The seven references of the star schema."""
    client, history, target = star.dim_cliente, star.historial_pagos, star.riesgo_crediticio

    def to_catalog(name: str, child: DataFrame, key: str, table: str, parent_key: str) -> ForeignKey:
        return ForeignKey(name, child, key, star.catalog(table), parent_key, True)

    return [
        to_catalog("FK_Cliente_Sexo", client, "id_sexo", "dim_sexo", "id_sexo"),
        to_catalog("FK_Cliente_Educacion", client, "id_educacion", "dim_educacion", "id_educacion"),
        to_catalog("FK_Cliente_EstadoCivil", client, "id_estado_civil", "dim_estado_civil", "id_estado_civil"),
        ForeignKey("FK_Historial_Cliente", history, "id_cliente", client, "id_cliente"),
        to_catalog("FK_Historial_Mes", history, "id_mes", "dim_tiempo_mes", "id_mes"),
        to_catalog("FK_Historial_Estatus", history, "id_estatus_pago", "dim_estatus_pago", "id_estatus"),
        ForeignKey("FK_Riesgo_Cliente", target, "id_cliente", client, "id_cliente"),
    ]


def orphans(fk: ForeignKey) -> DataFrame:
    """Child key values without a parent, with the rows they cover (NULL keys are allowed).

    Child rows are counted by key before the anti-join: a hot key is one row.
    """
    keys = (
        fk.child.where(F.col(fk.child_key).isNotNull())
        .groupBy(F.col(fk.child_key).cast("long").alias("clave"))
        .agg(F.count("*").alias("filas"))
    )
    parents = fk.parent.select(F.col(fk.parent_key).cast("long").alias("clave"))
    return keys.join(F.broadcast(parents) if fk.parent_is_catalog else parents, "clave", "left_anti").select(
        F.lit(fk.name).alias("restriccion"), "clave", "filas"
    )


def _catalog_orphans(keys: Sequence[ForeignKey]) -> DataFrame:
    """The same for several keys of one child into catalogs: one scan of the child."""
    child = keys[0].child
    pairs = child.select(*[F.col(fk.child_key).cast("long").alias(fk.name) for fk in keys])
    counts = (
        pairs.unpivot([], [fk.name for fk in keys], "restriccion", "clave")
        .where(F.col("clave").isNotNull())
        .groupBy("restriccion", "clave")
        .agg(F.count("*").alias("filas"))
    )
    known = reduce(
        DataFrame.unionByName,
        [
            fk.parent.select(F.lit(fk.name).alias("restriccion"), F.col(fk.parent_key).cast("long").alias("clave"))
            for fk in keys
        ],
    )
    return counts.join(F.broadcast(known), ["restriccion", "clave"], "left_anti")


def orphan_report(keys: Sequence[ForeignKey]) -> DataFrame:
    """One row per constraint: orphaned key values and orphaned rows."""
    by_child: dict[int, list[ForeignKey]] = {}
    parts = []
    for fk in keys:
        if fk.parent_is_catalog:
            by_child.setdefault(id(fk.child), []).append(fk)
        else:
            parts.append(orphans(fk))
    parts += [_catalog_orphans(group) for group in by_child.values()]
    found = reduce(DataFrame.unionByName, parts)
    names = [F.struct(F.lit(fk.name).alias("restriccion")) for fk in keys]
    every = keys[0].child.sparkSession.range(1).select(F.inline(F.array(*names)))
    sums = found.groupBy("restriccion").agg(F.count("*").alias("claves"), F.sum("filas").alias("filas"))
    return every.join(F.broadcast(sums), "restriccion", "left").select(
        "restriccion",
        F.coalesce("claves", F.lit(0)).alias("claves_huerfanas"),
        F.coalesce("filas", F.lit(0)).alias("filas_huerfanas"),
    )


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass. A rule is true when broken."""
    wide = df.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in rules.items()])
    return wide.unpivot([], list(rules), "regla", "filas")


def client_rules() -> dict[str, Column]:
    """NOT NULL columns and the 0..255 age range of the client table."""
    rules = {
        f"{c}_nulo": F.col(c).isNull()
        for c in ["id_cliente", "id_sexo", "id_educacion", "id_estado_civil", "edad", "limite_credito"]
    }
    rules["edad_fuera_de_rango"] = ~F.col("edad").between(0, 255)
    return rules


def target_rules() -> dict[str, Column]:
    """NOT NULL and {0, 1} of the target table."""
    return {
        "id_cliente_nulo": F.col("id_cliente").isNull(),
        "incumplimiento_proximo_mes_nulo": F.col("incumplimiento_proximo_mes").isNull(),
        "incumplimiento_fuera_de_rango": ~F.col("incumplimiento_proximo_mes").isin(0, 1),
    }


def history_rules() -> dict[str, Column]:
    """NOT NULL columns of the history; its two amounts may be NULL."""
    return {f"{c}_nulo": F.col(c).isNull() for c in ["id_cliente", "id_mes", "id_estatus_pago"]}
