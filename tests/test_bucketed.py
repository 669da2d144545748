"""The star in buckets by client, and procedures as table functions."""

from decimal import Decimal

import pytest
from helpers import client, empty_star, staging, staging_row, star, values

from riskloom.operators.star import ml_dataset
from riskloom.sources import tables
from riskloom.sources.bucketed import store_star


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small(spark):
    people = [client(i) for i in range(1, 40)] + [client(None)]
    history = [(i, m, 0, Decimal("5.00"), None) for i in range(1, 40) for m in (1, 2, 2)]
    history += [(7, 1, k % 8, Decimal(k), Decimal(k)) for k in range(200)]  # a client with most rows
    return star(spark, people, [(i, i % 2) for i in range(1, 40, 3)] + [(None, 1)], [*history, (None, 1, 0, None, None)])


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize(("buckets", "files"), [(1, 1), (5, 1), (5, 4), (64, 2)])
def test_buckets_hold_the_same_rows_and_joins_do_not_shuffle(spark, small, no_broadcast, buckets, files):
    stored = store_star(small, "cubos", buckets, history_files=files)
    for name in ("dim_cliente", "riesgo_crediticio", "historial_pagos"):
        assert _rows(getattr(stored, name)) == _rows(getattr(small, name))
    got = ml_dataset(stored)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert "Exchange" in ml_dataset(small)._jdf.queryExecution().executedPlan().toString()
    assert _rows(got) == _rows(ml_dataset(small))


def test_a_second_call_leaves_the_frames_of_the_first(spark, small):
    first = ml_dataset(store_star(small, "cubos", 3))
    second = ml_dataset(store_star(empty_star(spark), "cubos", 7))
    assert second.isEmpty() and _rows(first) == _rows(ml_dataset(small))


def test_counts_below_one_are_refused(spark, small):
    for settings in ({"buckets": 0}, {"buckets": 2, "history_files": 0}):
        with pytest.raises(ValueError):
            store_star(small, "cubos", **settings)


def test_procedures(spark):
    s = star(spark, [client(1), client(2)], [(1, 0)], [(1, 1, 0, Decimal("3.00"), None), (2, 2, -1, None, None), (2, 9, 0, None, None)])
    tables.register_views(s, staging(spark, *[staging_row(i) for i in (5, 2, 9, 1)]))
    tables.register_procedures(spark)
    tables.register_procedures(spark)  # again, in a session that has them
    run = lambda text: tables.run_query(spark, text)
    assert values(run("SELECT * FROM lote_siguiente(2)"), "ID") == [(1,), (2,)]
    assert run("SELECT * FROM lote_siguiente(500)").count() == 4
    assert run("SELECT * FROM lote_siguiente(0)").isEmpty() and run("SELECT * FROM lote_siguiente(501)").isEmpty()
    assert run("SELECT * FROM lote_siguiente(2)").columns == staging(spark).columns
    assert values(run("SELECT * FROM historial_cliente(1)"), "id_cliente", "monto_estado_cuenta") == [(1, Decimal("3.00"))]
    assert run("SELECT * FROM historial_cliente(NULL)").isEmpty()
    each = run("SELECT l.ID FROM lote_siguiente(3) l, LATERAL historial_cliente(l.ID) h")
    assert values(each, "ID") == [(1,), (2,)]  # a month outside the catalog has no row
    assert tuple(run("SELECT * FROM resumen_migracion()").first()) == (4, 2, 1, 3, 4)
    with pytest.raises(ValueError):
        run("CREATE TEMPORARY FUNCTION f() RETURNS INT RETURN 1")
