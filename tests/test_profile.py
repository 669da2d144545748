import bisect
import math

import pytest
from helpers import values
from pyspark.sql import functions as F

from riskloom.operators.reshape import to_variables
from riskloom.operators import profile, sketches
from riskloom.session import scratch_path


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(i % 3, float(i * i % 37), float(i), None if i % 10 == 0 else float(-2 * i)) for i in range(100)]
    return spark.createDataFrame(rows, "g int, a double, b double, h double").repartition(5)


def test_describe_golden(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "x int")
    row = profile.describe(df).first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (4, 4.0, 1.0, 10.0)
    assert (row["q25"], row["q50"], row["q75"]) == (1.75, 2.5, 4.75)
    assert row["std"] == pytest.approx(math.sqrt(50 / 3))


def test_missing_and_info(numbers):
    assert dict(values(profile.missing_by_column(numbers), "columna", "faltantes"))["h"] == 10
    info = {r["columna"]: r for r in profile.frame_info(numbers).collect()}
    assert (info["h"]["no_nulos"], info["h"]["filas"], info["g"]["tipo"], info["b"]["posicion"]) == (90, 100, "int", 2)


def test_histogram_golden(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("x")).repartition(3)
    assert [n for _, n in values(profile.histogram(df, "x", 5), "bin", "n")] == [2, 2, 2, 2, 3]


def test_histogram_keeps_empty_bins_and_all_rows(numbers):
    out = profile.histogram(numbers, "a", 25, by="g")
    assert out.count() == 75
    assert out.agg(F.sum("n")).first()[0] == 100


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [n for _, n in values(profile.histogram(df, "x", 4), "bin", "n")] == [2, 0, 0, 0]


def test_box(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 100]] + [("b", 1.0)], "g string, x double")
    rows = {r["g"]: r for r in profile.box_statistics(df, "x", ["g"]).collect()}
    a = rows["a"]
    assert (a["q25"], a["q50"], a["q75"]) == (2.0, 3.0, 4.0)
    assert (a["bigote_inf"], a["bigote_sup"], a["atipicos"]) == (1.0, 4.0, 1)
    assert rows["b"]["n"] == 1
    whole = profile.box_statistics(df, "x").first()
    assert whole["n"] == 6 and whole["atipicos"] == 1


def test_density_equals_the_direct_sum(spark):
    xs = [float((i * 37) % 101) ** 1.5 for i in range(400)]
    out = profile.density(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 50).collect()
    n = len(xs)
    mean = sum(xs) / n
    h = math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1)) * n**-0.2
    for r in out:
        direct = sum(math.exp(-0.5 * ((r["x"] - x) / h) ** 2) for x in xs) / (n * h * math.sqrt(2 * math.pi))
        assert r["densidad"] == pytest.approx(direct, rel=1e-9)


def test_correlation_pairwise_and_constant(spark, numbers):
    matrix = profile.correlation_matrix(numbers.withColumn("k", F.lit(1.0)), ["a", "b", "h", "k"])
    out = {(r["x"], r["y"]): r["r"] for r in matrix.collect()}
    assert len(out) == 16
    assert out["b", "h"] == pytest.approx(-1.0) and out["b", "b"] == 1.0
    assert out["b", "k"] is None and out["k", "k"] is None
    want = numbers.where("h is not null").agg(F.corr("a", "h")).first()[0]
    assert out["a", "h"] == pytest.approx(want) and out["h", "a"] == out["a", "h"]


def test_top_correlations(numbers):
    top = profile.top_correlations(numbers, "b", 1).first()
    assert top["variable"] == "h" and top["r_abs"] == pytest.approx(1.0)
    assert profile.top_correlation_matrix(numbers, "b", 2).count() == 9


def test_probability_statistics(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (0.5,)], "p double")
    row = profile.probability_statistics(df, "p").first()
    assert (row["media"], row["mediana"]) == (0.5, 0.5)
    assert row["desviacion"] == pytest.approx(math.sqrt(0.125))


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (float("nan"), 3), (None, 4)], "x double, y int")
    row = profile.describe(df, ["x"]).first()
    assert (row["count"], row["mean"], row["min"], row["q50"], row["max"]) == (2, 1.5, 1.0, 1.5, 2.0)
    assert {r["columna"]: r["faltantes"] for r in profile.missing_by_column(df).collect()} == {"x": 2, "y": 0}
    assert {r["columna"]: r["no_nulos"] for r in profile.frame_info(df).collect()} == {"x": 2, "y": 4}
    assert profile.correlation_pairs(df, ["x", "y"]).first()["r"] == pytest.approx(1.0)


def test_merged_sketches_answer_like_one_of_all_rows(spark):
    """Ranks of merged sketches, of one sketch and of the exact order agree within the stated error."""
    rows = spark.range(30_000).select(
        F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 7).alias("x"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("y"),
        F.lit(None).cast("double").alias("none"),
    )
    path, columns, steps = scratch_path(spark, "sketches"), ["x", "y", "none"], [0.0, 0.1, 0.5, 0.9, 1.0]
    for batch in (0, 1, 2, 1):
        sketches.append_sketches(sketches.column_sketches(rows.where(F.col("id") % 3 == batch), columns, 1_000), path, batch)
    merged = sketches.quantiles(sketches.merged(sketches.read_sketches(spark, path)), steps).collect()
    whole = sketches.quantiles(sketches.column_sketches(rows, columns, 1_000), steps).collect()
    held = {c: sorted(r[c] for r in rows.select(c).collect() if r[c] is not None) for c in columns}
    error = sketches.rank_error(1_000)
    for found in (merged, whole):
        assert len(found) == 15
        for r in found:
            values_ = held[r["columna"]]
            assert r["filas"] == len(values_)
            if not values_:
                assert r["valor"] is None
                continue
            low, high = (f(values_, r["valor"]) / len(values_) for f in (bisect.bisect_left, bisect.bisect_right))
            assert low - error <= r["p"] <= high + error


def test_box_per_column_stays_wide(spark):
    """NULL, NaN, outliers and a column without values; no row is copied for each column."""
    rows = spark.range(200).select(
        F.when(F.col("id") % 9 != 0, F.col("id") * F.col("id")).alias("a"), F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("id") % 5).alias("b"),
        F.lit(None).cast("double").alias("c"), F.when(F.col("id") < 3, -1e6).otherwise(F.rand(3)).alias("d"),
    ).cache()
    names = ["a", "b", "c", "d"]
    wide = profile.box_statistics_wide(rows, names)
    by_rows = profile.box_statistics(to_variables(rows, names), "value", ["variable"])
    assert wide.columns == by_rows.columns and sorted(wide.collect()) == sorted(by_rows.collect())
    assert "Expand" not in wide._jdf.queryExecution().executedPlan().toString()
    assert profile.box_statistics_wide(rows, ["c"]).collect() == []
    rows.unpersist()
