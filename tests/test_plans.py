"""The physical plans that large inputs depend on, with broadcast by size switched off."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from riskloom.operators.filters import exists_flag

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan_of(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def plan(name):
        return contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    yield plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize(
    "name",
    ["client_kpis", "ml_dataset", "star_enrich_top", "count_by_education", "history_unpivot", "snapshot_audit",
     "fk_orphans", "migrate_batch_history", "histogram_by_class", "kde_grid", "correlation_matrix", "standardize",
     "roc_curve", "nearest_centroid", "impute_means_batch", "stratified_fold_counts", "value_frequency",
     "migration_summary", "document_flatten"],
)
def test_no_cross_join_and_no_python(plan_of, name):
    plan = plan_of(name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def shuffles(plan):
    return len(re.findall("Exchange hashpartitioning", plan))


def test_pivot_partitioning_serves_the_joins(plan_of):
    plan = plan_of("ml_dataset")
    assert shuffles(plan) == 3 and plan.count("SortMergeJoin") == 2


def test_kpis_shuffle_each_side_once_and_read_few_columns(plan_of):
    plan = plan_of("client_kpis")
    assert shuffles(plan) == 2
    assert "o_orderdate" not in plan and "o_orderpriority" not in plan


def test_snapshots_are_compared_in_one_shuffle(plan_of):
    assert shuffles(plan_of("snapshot_audit")) == 1


def test_key_filter_reaches_the_scan(plan_of):
    assert "EqualTo(l_orderkey,52)" in plan_of("fact_history_of_key")


def test_row_work_does_not_shuffle(plan_of):
    for name in ("fact_history_enriched", "standardize", "document_flatten"):
        assert shuffles(plan_of(name)) == 0


def test_labels_are_joined_after_the_shuffle(plan_of):
    exchanges = [line for line in plan_of("client_detail_view").splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("descripcion" in line or "nivel_educativo" in line for line in exchanges)


def test_the_few_first_clients_meet_their_labels_without_a_shuffle(plan_of):
    assert shuffles(plan_of("star_enrich_top")) == 0  # the ten rows were found before, by narrow scans


def test_existence_pushes_its_condition_down(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet")
    flag = exists_flag(rows, F.col("o_totalprice") > 400_000)
    assert "GreaterThan(o_totalprice" in flag._jdf.queryExecution().executedPlan().toString()
    assert flag.first()["existe"] == 1 and exists_flag(rows, F.lit(False)).first()["existe"] == 0
