import pytest
from helpers import client, empty_star, staging, staging_row, star, values
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from riskloom.operators import integrity, keyfilter, migration
from riskloom.operators.reshape import unpivot_history
from riskloom.schemas import CreditStar
from riskloom.session import scratch_path
from riskloom.sources.batches import CreditStore, load_star
from riskloom.streaming import batch_loads


def report(result):
    return tuple(result.report.first())


def held(star_):
    """Cut the plans between batches of a test."""
    return CreditStar(*[f.checkpoint() for f in (star_.dim_cliente, star_.riesgo_crediticio, star_.historial_pagos)])


def test_batches_until_empty(spark):
    left, now = staging(spark, *[staging_row(i) for i in (4, 2, 5, 1, 3)]), empty_star(spark)
    one = migration.migrate_batch(left, now, 2)
    assert report(one) == (2, 2, 3)
    assert values(one.new_clients, "id_cliente") == [(1,), (2,)]
    left, now = one.staging.checkpoint(), held(one.applied_to(now))
    two = migration.migrate_batch(left, now, 10)
    assert report(two) == (10, 3, 0)
    now = held(two.applied_to(now))
    assert now.historial_pagos.count() == 30
    with pytest.raises(ValueError, match="no rows in staging"):
        migration.migrate_batch(two.staging, now, 1)


@pytest.mark.parametrize("n", [0, -1, None, True])
def test_bad_sizes(spark, n):
    with pytest.raises(ValueError):
        migration.migrate_batch(staging(spark, staging_row(1)), empty_star(spark), n)
    with pytest.raises(ValueError):
        migration.delete_first_n(staging(spark, staging_row(1)), n)


def test_batches_equal_one_full_load(spark):
    rows = [staging_row(i, PAY_0=i % 4, AGE=20 + i) for i in range(1, 8)]
    left, now = staging(spark, *rows), empty_star(spark)
    while left.limit(1).count():
        step = migration.migrate_batch(left, now, 3)
        left, now = step.staging.checkpoint(), held(step.applied_to(now))
    whole = migration.full_load(staging(spark, *rows))
    for a, b in zip(
        (now.dim_cliente, now.riesgo_crediticio, now.historial_pagos),
        (whole.dim_cliente, whole.riesgo_crediticio, whole.historial_pagos),
    ):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_existing_client_is_left_alone(spark):
    now = star(spark, [client(4, age=77)], [(4, 1)])
    got = migration.migrate_batch(staging(spark, staging_row(4, AGE=30)), now, 5)
    assert report(got) == (5, 1, 0)
    assert got.new_clients.count() == 0 and got.new_targets.count() == 0
    assert got.new_history.count() == 6


def test_rules_apply_to_inserted_rows_only(spark):
    now = star(spark, [client(4)], [(4, 1)])
    twice = staging(spark, staging_row(4, SEX=9), staging_row(4, PAY_0=1))
    got = migration.migrate_batch(twice, now, 5)
    assert report(got) == (5, 2, 0)
    assert got.new_clients.count() == 0 and got.new_history.count() == 12
    with pytest.raises(ValueError, match="ID_repetido"):
        migration.migrate_batch(twice, CreditStar(now.dim_cliente, now.riesgo_crediticio.where("false"), now.historial_pagos), 5)


def test_changed_status_is_a_new_history_row(spark):
    now = star(spark, [client(7)], [(7, 0)], [(7, 1, 0, None, None)])
    got = migration.migrate_batch(staging(spark, staging_row(7, PAY_0=2)), now, 1)
    months = [r["id_mes"] for r in got.applied_to(now).historial_pagos.collect()]
    assert months.count(1) == 2


def test_second_run_of_a_batch_adds_nothing(spark):
    rows = staging(spark, staging_row(1), staging_row(2))
    now = held(migration.migrate_batch(rows, empty_star(spark), 5).applied_to(empty_star(spark)))
    again = migration.migrate_batch(rows, now, 5)
    assert again.new_clients.count() + again.new_targets.count() + again.new_history.count() == 0


@pytest.mark.parametrize(
    "rows, reason",
    [
        ([staging_row(3), staging_row(3, AGE=40)], "ID_repetido"),
        ([staging_row(1, PAY_4=None)], "id_estatus_pago_nulo"),
        ([staging_row(1, PAY_4=10)], "id_estatus_pago_sin_catalogo"),
        ([staging_row(1, AGE=300)], "edad_fuera_de_rango"),
        ([staging_row(1, SEX=3)], "id_sexo_sin_catalogo"),
        ([staging_row(1, LIMIT_BAL=None)], "limite_credito_nulo"),
        ([staging_row(1, default_payment_next_month=None)], "incumplimiento_proximo_mes_nulo"),
        ([staging_row(None), staging_row(2)], "without ID"),
    ],
)
def test_rejected_batches(spark, rows, reason):
    with pytest.raises(ValueError, match=reason):
        migration.migrate_batch(staging(spark, *rows), empty_star(spark), 10)


def test_rows_of_one_file_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(migration, "TASK_ROWS", 10)
    rows = staging(spark, *[staging_row(i) for i in range(60)]).coalesce(1)
    for n, parts in ((60, 6), (35, 4), (10, 1)):
        plan = migration.plan_batch(rows, n)
        assert len(plan.batch.inputFiles()) >= parts and plan.batch.count() == n
        assert (parts > 1) == (len(plan.batch.inputFiles()) > 1)


def test_join_delete_keeps_null_ids(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "ID long")
    gone = spark.createDataFrame([(2,)], "ID long")
    left = migration.without_ids(rows, "ID", gone, "ID")
    assert sorted([r["ID"] for r in left.collect()], key=lambda x: (x is None, x)) == [1, 3, None]


def test_delete_first_n(spark):
    rows = staging(spark, *[staging_row(i) for i in (5, 3, 1, 4, 2)])
    left, told = migration.delete_first_n(rows, 2)
    assert tuple(told.first()) == (2, 2, 3)
    assert values(left, "ID") == [(3,), (4,), (5,)]


def test_null_ids_take_places(spark):
    rows = spark.createDataFrame([(None,), (1,), (1,), (2,)], "ID long")
    left, told = migration.delete_first_n(rows, 2)
    assert tuple(told.first()) == (2, 2, 2)
    assert sorted([r["ID"] for r in left.collect()], key=lambda x: (x is None, x)) == [2, None]
    left, told = migration.delete_first_n(rows, 1)
    assert tuple(told.first()) == (1, 0, 4) and left.count() == 4


def test_delete_clients(spark):
    now = star(spark, [client(1), client(2)], [(1, 0), (2, 1)], [(1, 1, 0, None, None), (2, 1, 0, None, None)])
    ids = spark.createDataFrame([(2,), (99,)], "id_cliente long")
    after, told = migration.delete_clients(now, ids)
    assert values(after.dim_cliente, "id_cliente") == [(1,)]
    assert values(after.historial_pagos, "id_cliente") == [(1,)]
    assert values(told, "id_cliente_eliminado") == [(2,), (99,)]


def test_store_publishes_all_or_nothing(spark, monkeypatch):
    store = CreditStore(spark, scratch_path(spark, "store"))
    store.load_staging(staging(spark, *[staging_row(i) for i in range(1, 6)]))
    assert tuple(store.migrate(2).first()) == (2, 2, 3)
    # a job that dies before the log row leaves its folders unseen
    monkeypatch.setattr(CreditStore, "log", lambda self, seen=store.log(): seen)
    store.migrate(1)
    assert store.star().dim_cliente.count() == 2
    monkeypatch.undo()
    spark.createDataFrame([(7,)], "id_cliente long").write.parquet(f"{store.root}/dim_cliente/lote=9")
    assert values(store.star().dim_cliente, "id_cliente") == [(1,), (2,), (3,)]
    store.migrate_all()
    assert store.star().historial_pagos.count() == 30
    assert store.staging().count() == 0


def test_full_load_round_trip(spark):
    star_ = load_star(staging(spark, staging_row(1), staging_row(2)), scratch_path(spark, "star"))
    assert star_.historial_pagos.count() == 12
    assert integrity.orphan_report(integrity.star_foreign_keys(star_)).where("filas_huerfanas > 0").count() == 0


def test_orphans_and_keys(spark):
    now = star(spark, [client(1, sex=9), client(1)], [(1, 0), (8, 1)], [(1, 7, 0, None, None), (None, 1, 0, None, None)])
    got = {r["restriccion"]: r["filas_huerfanas"] for r in integrity.orphan_report(integrity.star_foreign_keys(now)).collect()}
    assert got["FK_Cliente_Sexo"] == 1 and got["FK_Historial_Mes"] == 1 and got["FK_Riesgo_Cliente"] == 1
    assert got["FK_Historial_Cliente"] == 0
    assert values(integrity.key_violations(now.dim_cliente, ["id_cliente"]), "id_cliente", "filas") == [(1, 2)]
    rules = integrity.rule_report(now.historial_pagos, integrity.history_rules())
    assert dict(values(rules, "regla", "filas"))["id_cliente_nulo"] == 1


def test_history_is_six_per_client(spark):
    wide = staging(spark, *[staging_row(i) for i in range(10)])
    assert unpivot_history(wide).groupBy("id_cliente").count().where(F.col("count") != 6).count() == 0


def test_key_filter_passes_every_key_and_few_others(spark):
    keys = spark.createDataFrame([(3 * i,) for i in range(500)] + [(None,)], "k long").repartition(3)
    found = keyfilter.key_filter(keys, "k")
    rows = spark.range(-2_000, 4_000).select(F.col("id").alias("k"))
    passed = {r["k"] for r in rows.where(found.passes("k")).collect()}
    assert passed >= {3 * i for i in range(500)} and min(passed) >= 0 and max(passed) <= 1_497
    assert len(passed) < 500 + 40
    assert keys.where(found.passes("k")).count() == 500
    parts = [keyfilter.key_filter(keys.where(c), "k", found.bits) for c in ("k < 600", "k >= 600", "k > 9000")]
    merged = parts[0].merged(parts[1]).merged(parts[2])
    assert {r["k"] for r in rows.where(merged.passes("k")).collect()} == passed
    assert rows.where(parts[2].passes("k")).count() == 0
    with pytest.raises(ValueError, match="different sizes"):
        parts[0].merged(keyfilter.key_filter(keys, "k", 64))


def test_a_batch_shuffles_only_loaded_rows_of_its_ids(spark):
    """The filter stands below the exchange of the loaded table, and its range goes into the scan."""
    path = scratch_path(spark, "loaded")
    spark.range(100_000).select(F.col("id").alias("id_cliente"), F.lit(1).alias("id_mes")).write.parquet(path)
    batch = spark.createDataFrame([(i,) for i in range(50_000, 50_020)], "id_cliente long")
    known = keyfilter.key_filter(batch, "id_cliente")
    loaded = spark.read.parquet(path)
    assert loaded.where(known.passes("id_cliente")).count() < 25
    unseen = migration.new_rows(batch, loaded.where("id_cliente <> 50007"), ["id_cliente"], known)
    assert values(unseen, "id_cliente") == [(50_007,)]
    plan = spark._jvm.PythonSQLUtils.explainString(unseen._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(id_cliente,50000)" in plan and "LessThanOrEqual(id_cliente,50019)" in plan


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id_cliente long")


def test_stored_deletes_and_compaction(spark, monkeypatch):
    store = CreditStore(spark, scratch_path(spark, "store"))
    store.load_staging(staging(spark, *[staging_row(i) for i in range(1, 9)]))
    store.migrate(3)
    assert values(store.delete_clients(_ids(spark, 2, 99, 2)), "id_cliente_eliminado") == [(2,), (99,)]

    def seen():
        now = store.star()
        assert values(now.historial_pagos.select("id_cliente").distinct(), "id_cliente") == values(now.dim_cliente, "id_cliente")
        assert values(now.riesgo_crediticio, "id_cliente") == values(now.dim_cliente, "id_cliente")
        return [i for (i,) in values(now.dim_cliente, "id_cliente")]

    assert seen() == [1, 3]
    # a delete that dies before its log row is not seen, also after its number went to a batch
    monkeypatch.setattr(CreditStore, "_commit", lambda self, *rest, **named: None)
    store.delete_clients(_ids(spark, 1))
    store.compact()
    monkeypatch.undo()
    assert seen() == [1, 3]
    store.migrate(2)
    assert seen() == [1, 3, 4, 5]
    # nor does a dead batch appear under the number of a delete
    monkeypatch.setattr(CreditStore, "_commit", lambda self, *rest, **named: spark.createDataFrame([(1, 1, 1)], "a int, b int, c int"))
    store.migrate(1)
    monkeypatch.undo()
    store.delete_clients(_ids(spark, 5))
    assert seen() == [1, 3, 4]
    before = [values(t, *t.columns) for t in (store.star().dim_cliente, store.star().historial_pagos)]
    store.compact()
    assert [values(t, *t.columns) for t in (store.star().dim_cliente, store.star().historial_pagos)] == before
    store.vacuum()
    assert [values(t, *t.columns) for t in (store.star().dim_cliente, store.star().historial_pagos)] == before
    store.migrate_all()
    assert seen() == [1, 3, 4, 6, 7, 8] and store.staging().count() == 0
    store.delete_clients(_ids(spark, 1, 8))
    assert seen() == [3, 4, 6, 7]


def test_a_deleted_client_can_be_loaded_again(spark):
    store = CreditStore(spark, scratch_path(spark, "store"))
    store.load_staging(staging(spark, staging_row(1), staging_row(2), staging_row(3)))
    store.delete_clients(_ids(spark, 2))  # nothing to delete yet: later rows stay
    store.migrate_all()
    assert values(store.star().dim_cliente, "id_cliente") == [(1,), (2,), (3,)]


def test_stored_delete_of_first_rows(spark):
    rows = [staging_row(i, AGE=20 + n) for n, i in enumerate((1, 2, 2, 2, 3, 4))]
    store, plain = CreditStore(spark, scratch_path(spark, "store")), staging(spark, *rows)
    store.load_staging(plain)
    for n in (3, 1, 1):
        want, told = migration.delete_first_n(plain, n)
        assert tuple(store.delete_first(n).first()) == tuple(told.first())
        assert values(store.staging(), "ID", "AGE") == values(want, "ID", "AGE")
        plain = want
    assert tuple(store.migrate(5).first()) == (5, 1, 0)


def test_a_numbered_load_is_published_once(spark):
    store = CreditStore(spark, scratch_path(spark, "store"))
    parts = [staging(spark, *[staging_row(i) for i in ids]) for ids in ((1, 2), (2, 3))]
    told = [store.load_numbered("a", k, parts[k]) for k in (0, 0, 1, 0, 1)] + [store.load_numbered("b", 0, parts[0].limit(0))]
    assert told == [True, False, True, False, False, False]
    assert values(store.star().dim_cliente, "id_cliente") == [(1,), (2,), (3,)]
    assert store.star().historial_pagos.count() == 18


def test_a_replayed_stream_loads_nothing_twice(spark, monkeypatch):
    arrivals, root = scratch_path(spark, "arrivals"), scratch_path(spark, "store")
    for ids in ((1, 2), (3,), (4, 5)):
        staging(spark, *[staging_row(i) for i in ids]).coalesce(1).write.mode("append").parquet(arrivals)
    store = CreditStore(spark, root)

    def run(checkpoint):
        batch_loads.load_arrivals(batch_loads.read_arrivals(spark, arrivals, 1), store, checkpoint).awaitTermination()

    # the job dies in its second micro-batch, after the commit
    publish, checkpoint = CreditStore.load_numbered, scratch_path(spark, "checkpoint")

    def dies(self, stream, number, rows):
        done = publish(self, stream, number, rows)
        if number == 1:
            raise RuntimeError("lost")
        return done

    monkeypatch.setattr(CreditStore, "load_numbered", dies)
    with pytest.raises(StreamingQueryException):
        run(checkpoint)
    monkeypatch.undo()
    assert store.log().count() == 2
    for again in (checkpoint, scratch_path(spark, "checkpoint")):  # resumed, then replayed from the start
        run(again)
        assert store.log().count() == 3
        assert values(store.star().dim_cliente, "id_cliente") == [(i,) for i in range(1, 6)]
        assert store.star().historial_pagos.count() == 30
