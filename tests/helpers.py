"""Small hand-made inputs."""

from decimal import Decimal

from riskloom.schemas import (
    BILL_COLUMNS,
    HISTORY_SCHEMA,
    PAID_COLUMNS,
    PAY_COLUMNS,
    STAGING_SCHEMA,
    TARGET_COLUMN,
    CLIENT_SCHEMA,
    TARGET_SCHEMA,
    CreditStar,
)


def staging_row(client, **changes):
    row = {"ID": client, "LIMIT_BAL": Decimal("1000.00"), "SEX": 1, "EDUCATION": 2, "MARRIAGE": 1, "AGE": 30}
    row |= dict.fromkeys(PAY_COLUMNS, 0)
    row |= {c: Decimal(f"{i}0.00") for i, c in enumerate(BILL_COLUMNS, 1)}
    row |= {c: Decimal(f"{i}.00") for i, c in enumerate(PAID_COLUMNS, 1)}
    row[TARGET_COLUMN] = 0
    row |= changes
    return tuple(row[c] for c in STAGING_SCHEMA.names)


def staging(spark, *rows):
    frame = spark.createDataFrame(list(rows), STAGING_SCHEMA)
    return frame.repartition(3) if rows else frame


def empty_star(spark):
    return CreditStar(
        spark.createDataFrame([], CLIENT_SCHEMA),
        spark.createDataFrame([], TARGET_SCHEMA),
        spark.createDataFrame([], HISTORY_SCHEMA),
    )


def client(i, sex=1, education=1, marital=1, age=20, limit="100.00"):
    return (i, sex, education, marital, age, Decimal(limit))


def star(spark, clients, targets, history=()):
    return CreditStar(
        spark.createDataFrame(list(clients), CLIENT_SCHEMA).repartition(2),
        spark.createDataFrame(list(targets), TARGET_SCHEMA).repartition(2),
        spark.createDataFrame(list(history), HISTORY_SCHEMA).repartition(2),
    )


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
