from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import ParseException
from helpers import client, staging, staging_row, star, values

from riskloom.functions import scalars
from riskloom.schemas import STAGING_SCHEMA
from riskloom.session import scratch_path, shared_root
from riskloom.sources import csvfiles, documents, tables
from pyspark.sql import functions as F


@pytest.fixture
def csv_folder(tmp_path):
    """Two files, each with both header lines and one client."""
    names = STAGING_SCHEMA.names
    first = ",".join(["", *[f"X{i}" for i in range(1, 24)], "Y"])
    for i in (1, 2):
        cells = [str(i), " 20000 ", "2", "2", "1", "24"] + ["0"] * 6 + ["3913.5"] * 6 + ["0"] * 6 + ["1"]
        Path(tmp_path, f"part{i}.csv").write_text("\n".join([first, ",".join(names), ",".join(cells)]) + "\n")
    return str(tmp_path)


def test_staging_csv(spark, csv_folder):
    rows = csvfiles.read_staging_csv(spark, csv_folder)
    assert rows.schema == STAGING_SCHEMA
    assert values(rows, "ID", "LIMIT_BAL", "BILL_AMT6") == [
        (1, Decimal("20000.00"), Decimal("3913.50")), (2, Decimal("20000.00"), Decimal("3913.50")),
    ]


def test_numeric_csv(spark, csv_folder):
    rows = csvfiles.read_numeric_csv(spark, csv_folder)
    assert values(rows, "ID", "LIMIT_BAL") == [(1.0, 20000.0), (2.0, 20000.0)]


@pytest.mark.parametrize("text", ["X, Y,Z\n ID, LIMIT_BAL ,t\n1,2,3\n", "ID, LIMIT_BAL ,t\n1,2,3\n"])
def test_sniffed_header(spark, tmp_path, text):
    Path(tmp_path, "a.csv").write_text(text)
    rows = csvfiles.read_sniffed_csv(spark, str(tmp_path))
    assert rows.columns == ["ID", "LIMIT_BAL", "t"]
    assert [tuple(r) for r in rows.collect()] == [(1.0, 2.0, 3.0)]


def _csv_line(**changes):
    cells = dict.fromkeys(STAGING_SCHEMA.names, "0") | {"ID": "1", "LIMIT_BAL": "5.00", "AGE": "30"} | changes
    return ",".join(cells.values())


def _csv(tmp_path, *lines):
    Path(tmp_path, "a.csv").write_text("\n".join([",".join(STAGING_SCHEMA.names), *lines]) + "\n")
    return str(tmp_path)


def test_csv_readers_lose_no_line(spark, tmp_path):
    target = STAGING_SCHEMA.names[-1]
    path = _csv(tmp_path, _csv_line(), _csv_line(ID=""), _csv_line(ID="3", **{target: ""}), _csv_line(ID="4", LIMIT_BAL=" "))
    rows = csvfiles.read_staging_csv(spark, path)
    assert {r["ID"]: r["LIMIT_BAL"] for r in rows.collect()}[4] is None
    assert {r["ID"] for r in rows.collect()} == {1, None, 3, 4}
    assert {r["ID"]: r[target] for r in rows.collect()} == {1: 0, None: 0, 3: None, 4: 0}
    assert {r["ID"] for r in csvfiles.read_sniffed_csv(spark, path).collect()} == {1.0, None, 3.0, 4.0}
    assert [r["ID"] for r in csvfiles.read_numeric_csv(spark, path).collect()] == [1.0]


@pytest.mark.parametrize("reader", [csvfiles.read_staging_csv, csvfiles.read_numeric_csv, csvfiles.read_sniffed_csv])
@pytest.mark.parametrize("bad", [_csv_line(ID="x9"), _csv_line(AGE="old"), "1,2,3", _csv_line() + ",7"])
def test_csv_readers_raise_on_bad_lines(spark, tmp_path, reader, bad):
    with pytest.raises(Exception, match="(?i)CAST_INVALID_INPUT|MALFORMED"):
        reader(spark, _csv(tmp_path, _csv_line(), bad)).select("ID").collect()
        reader(spark, _csv(tmp_path, _csv_line(), bad)).collect()


@pytest.mark.parametrize("text", [
    "WITH x AS (SELECT 7 AS a) INSERT INTO t SELECT a FROM x", "/* read */ DROP TABLE t", "SELECT 1; SELECT 2", "-- x\nINSERT INTO t VALUES (1)",
    "SET a=b", "CREATE VIEW v AS SELECT 1", "SELECT TRANSFORM(a) USING 'cat' AS b FROM t", "SHOW TABLES", "DELETE FROM t", "not sql",
])
def test_statements_that_do_not_only_read_are_refused(spark, text):
    with pytest.raises((ValueError, ParseException)):
        tables.run_query(spark, text)


@pytest.mark.parametrize("text", ["SELECT 1 AS a", "/* x */ with x as (select 1 a) select * from x", "VALUES (1)"])
def test_reading_statements_run(spark, text):
    assert tables.run_query(spark, text).first()[0] == 1


def test_views_preview_and_queries(spark):
    s = star(spark, [client(1)], [(1, 0)], [(1, 1, 0, None, None)])
    tables.register_views(s, staging(spark, staging_row(2)))
    assert tables.read_view(spark, "vw_cliente_detallado").first()["sexo"] == "Masculino"
    assert tables.preview(spark, "dim_educacion", 10).count() == 7
    with pytest.raises(ValueError):
        tables.preview(spark, "dim_educacion", 5)
    assert tables.run_query(spark, " with x as (select 1 a) select * from x").first()[0] == 1
    with pytest.raises(ValueError):
        tables.run_query(spark, "DROP VIEW dim_sexo")
    assert tuple(tables.read_view(spark, "vw_resumen_migracion").first()) == (1, 1, 1, 1, 1)
    assert tables.table_exists(spark, "dim_sexo") == 1 and tables.table_exists(spark, "nope") == 0
    listed = [r["tabla"] for r in tables.list_tables(spark, "VIEW", exclude=("dim_sexo",)).collect()]
    assert "vw_ml_dataset" in listed and "dim_sexo" not in listed and listed == sorted(listed)


def test_inventory(spark, tmp_path):
    for name, n in [("a", 30), ("b", 5)]:
        spark.range(n).repartition(3).write.parquet(f"{tmp_path}/{name}")
    frames = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in "ab"}
    rows = tables.table_inventory(frames)
    assert [(r["tabla"], r["filas"], r["archivos"]) for r in rows.collect()] == [("a", 30, 3), ("b", 5, 3)]
    size = sum(f.stat().st_size for f in Path(tmp_path).glob("*/*.parquet"))
    assert sum(r["bytes"] for r in rows.collect()) == size
    totals = tables.inventory_totals(rows).first()
    assert (totals["total_tablas"], totals["total_filas"], totals["promedio_filas"]) == (2, 35, 17)


def test_jdbc_needs_all_range_arguments(spark):
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, "jdbc:none:", "t", partition_column="id")


def test_documents(spark):
    path = scratch_path(spark, "docs")
    documents.append_experiment(
        spark, path, "2024-01-02T03:04:05.678", "K-Means", {"n_clusters": 3}, {"silhouette_score": 0.25, "inertia": 12.5}
    )
    documents.append_experiment(
        spark, path, "2024-01-03T00:00:00", "Random Forest", {"n_estimators": 100}, {"accuracy": 0.8, "f1_score": 0.5}
    )
    assert '"n_clusters": 3}' in "".join(r["value"] for r in spark.read.text(path).collect())
    Path(path, "empty.json").write_text("{}\n")
    shown = documents.flatten_documents(documents.read_documents(spark, path))
    flat = values(shown, "fecha", "algoritmo", "tamano_modelo", "calidad", "inercia_f1", "registros")
    assert flat == [
        ("2024-01-02T03:04:05", "K-Means", "3", "0.25", "12.5", "N/A"),
        ("2024-01-03T00:00:00", "Random Forest", "100", "0.8", "0.5", "N/A"),
        ("N/A", "N/A", "N/A", "N/A", "N/A", "N/A"),
    ]
    docs = documents.read_documents(spark, path)
    assert tuple(documents.count_by_algorithm(docs).first()) == (3, 1, 1)
    assert documents.latest_documents(docs, n=1).first()["algoritmo"] == "Random Forest"
    assert documents.latest_documents(docs, "K-Means").count() == 1
    assert values(documents.explode_parameters(docs), "parametro", "valor") == [("n_clusters", "3"), ("n_estimators", "100")]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.bit_text(F.lit(True)).alias("bit"),
        scalars.round_half_even(F.lit(2.125), 2).alias("even"),
        scalars.qualified_name(F.lit(None), F.lit("t")).alias("null_name"),
        scalars.row_label(F.lit(3), F.lit(None), F.lit("x")).alias("label"),
        scalars.label_of(F.lit(7), {1: "a"}).alias("unlisted"),
        scalars.to_number(F.lit(" 1.5 ")).alias("n"),
        scalars.to_number(F.lit("abc")).alias("bad"),
        scalars.is_query(F.lit(" select 1")).alias("reads"),
        scalars.percent(F.lit(1), F.lit(0)).alias("nothing"),
    ).first()
    assert tuple(row) == ("1", 2.12, None, "3 - x", None, 1.5, None, True, None)


def test_shared_root_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_documents_keep_fields_that_no_schema_names(spark):
    path = scratch_path(spark, "open")
    first = ['{"fecha": "2024", "nuevo": {"a": [1, 2.5]}, "semilla": 7}', "no json", "null", "{}"]
    second = ['{"semilla": "siete", "metricas": {"inertia": 3}}', None]
    for lines in (first, second):
        texts = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, t string")
        documents.append_open_documents(documents.open_documents(texts, "t"), path)
    back = documents.read_open_documents(spark, path)
    assert back.count() == 6
    got = back.select(
        documents.lookup("documento", "$.nuevo.a[1]", kind="double", default=0.0).alias("a"),
        documents.lookup("documento", "$.semilla", default="N/A").alias("s"),
        documents.lookup("documento", "$.metricas.silhouette_score", "$.metricas.inertia", kind="int", default=-1).alias("m"),
    )
    assert values(got, "a", "s", "m") == sorted([(2.5, "7", -1), (0.0, "siete", 3)] + [(0.0, "N/A", -1)] * 4)
    fields = {r["campo"]: (r["documentos"], r["tipo"]) for r in documents.document_fields(back).collect() if r["campo"]}
    assert fields["semilla"] == (2, "VARIANT") and fields["fecha"][0] == 1 and set(fields) == {"fecha", "nuevo", "semilla", "metricas"}
