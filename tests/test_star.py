from decimal import Decimal

from helpers import client, staging, staging_row, star, values
from pyspark.sql import functions as F

from riskloom.operators import aggregates, filters, reshape
from riskloom.operators import star as ops
from riskloom.schemas import BILL_COLUMNS, HISTORY_SCHEMA, PAID_COLUMNS, PAY_COLUMNS, STAGING_SCHEMA


def test_unpivot_keeps_empty_months(spark):
    wide = staging(spark, staging_row(1, PAY_0=2, PAY_2=-1, BILL_AMT2=None, PAY_AMT2=None))
    rows = {r["id_mes"]: r for r in reshape.unpivot_history(wide).collect()}
    assert len(rows) == 6
    assert rows[1]["id_estatus_pago"] == 2
    assert rows[2]["id_estatus_pago"] == -1
    assert rows[2]["monto_estado_cuenta"] is None and rows[2]["monto_pago_anterior"] is None


def test_pivot_of_missing_and_repeated_months(spark):
    history = spark.createDataFrame(
        [(1, 1, 0, Decimal(500), None), (1, 1, 2, Decimal(100), None), (2, 1, 1, Decimal(1), Decimal(2)), (2, 3, 4, None, None)],
        HISTORY_SCHEMA,
    )
    rows = {r["id_cliente"]: r for r in reshape.pivot_history(history).collect()}
    assert (rows[1]["PAY_0"], rows[1]["BILL_AMT1"]) == (2, Decimal(500))
    assert (rows[2]["PAY_0"], rows[2]["PAY_3"], rows[2]["PAY_2"]) == (1, 4, None)


def test_pivot_undoes_unpivot(spark):
    rows = [staging_row(i, PAY_0=i % 5, BILL_AMT3=None, PAY_AMT6=Decimal(i)) for i in range(1, 30)]
    wide = staging(spark, *rows)
    back = reshape.pivot_history(reshape.unpivot_history(wide)).withColumnRenamed("id_cliente", "ID")
    measures = PAY_COLUMNS + BILL_COLUMNS + PAID_COLUMNS
    assert back.select("ID", *measures).exceptAll(wide.select("ID", *measures)).count() == 0
    assert back.count() == 29


def test_ml_dataset_drops_incomplete_clients(spark):
    s = star(
        spark, [client(1), client(2), client(3)], [(1, 0), (2, 1)],
        [(1, 1, 0, None, None), (3, 1, 0, None, None)],
    )
    assert values(ops.ml_dataset(s), "id_cliente") == [(1,)]
    assert len(ops.ml_dataset(s).columns) == 25


def test_kpis(spark):
    s = star(spark, [client(1, age=20), client(2, age=21, limit="300.00")], [(1, 1), (2, 0)])
    row = ops.client_kpis(s).first()
    assert (row["total"], row["avg_limite"], row["avg_edad"], row["tasa"]) == (2, 200.0, 20.5, 50.0)
    assert ops.client_kpis(s, truncate_int_avg=True).first()["avg_edad"] == 20


def test_kpis_of_nothing(spark):
    row = ops.client_kpis(star(spark, [client(1)], [])).first()
    assert (row["total"], row["tasa"]) == (0, None)


def test_equal_labels_merge(spark):
    s = star(spark, [client(1, education=5), client(2, education=6), client(3, education=1)], [])
    got = ops.count_by_label(s.dim_cliente, "id_educacion", s.catalog("dim_educacion"), "id_educacion", "nivel_educativo")
    assert values(got, "nivel_educativo", "cantidad") == [("Desconocido", 2), ("Posgrado", 1)]


def test_member_lists(spark):
    entities = spark.createDataFrame([(1, "ana"), (2, "luis")], "e int, name string")
    links = spark.createDataFrame([(1, 10), (1, 20), (1, 10)], "e int, m int")
    members = spark.createDataFrame([(10, "b"), (20, "a")], "m int, role string")
    got = aggregates.members_by_entity(entities, "e", "name", links, "m", members, "role")
    assert [(r["name"], r["miembros"]) for r in got.collect()] == [("ana", "a, b"), ("luis", None)]


def test_recode(spark):
    df = spark.createDataFrame([(e, e % 4) for e in range(7)], "Educacion int, Estado_Civil int")
    got = filters.recode_categories(df.coalesce(1)).collect()
    assert [r["Educacion"] for r in got] == [4, 1, 2, 3, 4, 4, 4]
    assert [r["Estado_Civil"] for r in got[:4]] == [3, 1, 2, 3]


def test_names_and_target():
    assert filters.find_target(["a", "Y", "z"]) == "Y"
    assert filters.find_target(["a", "z"]) == "z"
    assert filters.report_names(STAGING_SCHEMA.names)["default_payment_next_month"] == "Incumplimiento"


def test_majority_tie_goes_to_smaller_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (0, 1), (1, 1)], "c int, y int")
    assert values(reshape.majority_class(df, "c", "y"), "c", "majority") == [(0, 0), (1, 1)]
    assert values(reshape.cross_table(df, "c", "y", [0, 1]), "c", "y_0", "y_1") == [(0, 2, 2), (1, 0, 1)]


def test_threshold_and_lists(spark):
    df = spark.createDataFrame([(0.35,), (0.3499,)], "p double")
    assert [r[0] for r in df.coalesce(1).select(filters.at_threshold(F.col("p"), 0.35)).collect()] == [1, 0]
    odd = spark.createDataFrame([("a",), (None,)], "x string").coalesce(1)
    assert [r[0] for r in odd.select(filters.in_list("x", ["a"], negate=True)).collect()] == [False, None]


def test_split_columns(spark):
    df = spark.createDataFrame([(1, 2, "x")], "Sexo int, Edad int, t string")
    assert filters.split_columns(df) == (["Edad", "t"], ["Sexo"])
    assert filters.numeric_columns(df) == ["Sexo", "Edad"]
