import random

import pytest
from helpers import values
from pyspark.sql import functions as F

from riskloom.ml import metrics


def test_report_golden(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    assert tuple(metrics.binary_counts(df, "y", "p").first()) == (2, 0, 1, 1, 2)
    rows = {r["clase"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    one = rows["1"]
    assert (one["precision"], one["recall"], one["soporte"]) == (1.0, 0.5, 2)
    assert one["f1"] == pytest.approx(2 / 3)
    assert rows["accuracy"]["f1"] == 0.75
    assert values(metrics.confusion_matrix(df, "y", "p"), "real", "predicho", "n") == [
        (0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 1),
    ]


def test_no_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    rows = {r["clase"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rows["1"]["precision"] == 0.0 and rows["1"]["f1"] == 0.0


@pytest.mark.parametrize("window_rows", [1_000_000, 1])
def test_roc_golden(spark, window_rows):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "s double, y int")
    points = values(metrics.roc_curve(df, "y", "s", window_rows), "fpr", "tpr")
    assert points == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    assert metrics.roc_auc(df, "y", "s", window_rows).first()[0] == 0.75


def test_equal_scores(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "s double, y int")
    assert values(metrics.roc_curve(df, "y", "s"), "fpr", "tpr") == [(0.0, 0.0), (1.0, 1.0)]
    assert metrics.roc_auc(df, "y", "s").first()[0] == 0.5


def test_one_class_only(spark):
    df = spark.createDataFrame([(0.5, 1)], "s double, y int")
    assert metrics.roc_auc(df, "y", "s").first()[0] is None


@pytest.mark.parametrize("window_rows", [1_000_000, 20])
def test_auc_counts_ordered_pairs(spark, window_rows):
    rng = random.Random(3)
    rows = [(rng.randrange(80) / 80, rng.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int").repartition(4)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    got = metrics.roc_auc(df, "y", "s", window_rows).first()[0]
    assert got == pytest.approx(want, abs=1e-12)
    back = metrics.roc_auc(df.withColumn("s", -F.col("s")), "y", "s", window_rows).first()[0]
    assert got + back == pytest.approx(1.0)


def test_threshold_rows_add_up(spark):
    df = spark.createDataFrame([(i / 20, i % 2) for i in range(20)], "p double, y int")
    for r in metrics.threshold_impact(df, "y", "p", [0.0, 0.35, 2.0]).collect():
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == 20
