import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import selection as s


def linear_quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    lo = math.floor(at)
    hi = math.ceil(at)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 'hot' holds most rows, a third of them one value; 'one' has a single row."""
    rng = random.Random(7)
    rows = [("hot", 5.0)] * 900 + [("hot", rng.lognormvariate(0, 3)) for _ in range(1800)]
    rows += [("cold", rng.uniform(-10, 10)) for _ in range(101)] + [("one", 3.5), (None, 1.0), ("cold", None)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(7)


@pytest.mark.parametrize("group_rows", [0, 1_000_000])
def test_quantiles_agree_with_sorting(skewed, group_rows):
    rows, df = skewed
    got = {r["g"]: r for r in s.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"], group_rows=group_rows).collect()}
    assert set(got) == {"hot", "cold", "one"}
    for g in got:
        mine = [x for h, x in rows if h == g and x is not None]
        assert got[g]["n"] == len(mine)
        for name, p in [("q0", 0.0), ("q25", 0.25), ("q50", 0.5), ("q90", 0.9), ("q100", 1.0)]:
            assert got[g][name] == pytest.approx(linear_quantile(mine, p), rel=1e-12)


def test_quantiles_of_the_whole_table(skewed):
    rows, df = skewed
    mine = [x for _, x in rows if x is not None]
    row = s.exact_quantiles(df, "x", [0.5], group_rows=0).first()
    assert row["q50"] == pytest.approx(linear_quantile(mine, 0.5))


def test_golden_quartiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    for group_rows in (0, 100):
        row = s.exact_quantiles(df, "x", [0.25, 0.5, 0.75], group_rows=group_rows).first()
        assert (row["q25"], row["q50"], row["q75"]) == (1.75, 2.5, 4.75)


@pytest.mark.parametrize("accuracy", [3, 10, 50_000])
def test_ranks_are_exact_for_any_sketch(spark, accuracy):
    values = [((i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    targets = {f"r{k}": (k / 1000, F.lit(k)) for k in (0, 1, 250, 998, 999)}
    row = s.order_statistics(df, "v", targets, accuracy=accuracy).first()
    assert [row[f"r{k}"] for k in (0, 1, 250, 998, 999)] == [0, 1, 250, 998, 999]


@pytest.mark.parametrize("group_rows", [5, 60])
def test_intervals_are_refined_until_they_fit(spark, monkeypatch, group_rows):
    monkeypatch.setattr(s, "REFINED_PARTS", 3)
    values = [float((i * 7919) % 3000) for i in range(3000)] + [1500.0] * 4000
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    ranks = (0, 10, 1500, 3000, 5499, 5500, 6999)
    targets = {f"r{k}": (k / 7000, F.lit(k)) for k in ranks}
    row = s.order_statistics(df, "v", targets, accuracy=20, group_rows=group_rows).first()
    assert [row[f"r{k}"] for k in ranks] == [sorted(values)[k] for k in ranks]


@pytest.mark.parametrize("window_rows", [1_000_000, 50, 4])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, window_rows, descending):
    rows = [("a" if i % 3 else "b", i / 7, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, m long").repartition(6)
    out = s.running_totals(df, "v", ["m"], ["g"], descending, window_rows)
    for g in "ab":
        mine = sorted([r for r in rows if r[0] == g], key=lambda r: r[1], reverse=descending)
        total, want = 0, {}
        for _, v, m in mine:
            total += m
            want[v] = total
        assert {r["v"]: r["cum_m"] for r in out.where(F.col("g") == g).collect()} == want


@pytest.mark.parametrize("top", [0, 10_000])
@pytest.mark.parametrize("copies", [1, 100_000])
def test_first_n_with_ties_and_nulls(spark, monkeypatch, top, copies):
    monkeypatch.setattr(s, "TOP_ON_DRIVER", top)
    monkeypatch.setattr(s, "COPIES_AT_ONCE", copies)
    rows = [(1, "a"), (2, "x"), (2, "x"), (2, "y"), (2, "z"), (3, "b"), (None, "n")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for n in range(0, 9):
        first, rest = s.split_first_n(df, "k", n)
        a, z = [tuple(r) for r in first.collect()], [tuple(r) for r in rest.collect()]
        assert sorted(a + z, key=key) == sorted(rows, key=key)
        assert len(a) == min(n, 6)
        assert all(x[0] is not None for x in a)
        if a:
            assert max(x[0] for x in a) <= min([x[0] for x in z if x[0] is not None], default=99)


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", None)], "x string, y int")
    assert tuple(s.count_duplicates(df).first()) == (4, 2, 2)
    assert df.dropDuplicates().count() == 2
    assert tuple(s.count_duplicates(df.where("false")).first()) == (0, 0, 0)


def test_head_and_tail(spark):
    df = spark.range(20).repartition(4)
    got = s.head_and_tail(df, "id", 2).collect()
    assert sorted((r["id"], r["place"]) for r in got) == [(0, "first"), (1, "first"), (18, "last"), (19, "last")]


def test_wide_quantiles_equal_those_by_rows(spark, monkeypatch):
    """Many ties, none, NULL and NaN, a constant column, a column without values; and a sketch that is of no use."""
    rows = spark.range(0, 5_000, 1, 4).select(
        F.rand(1).alias("a"), (F.rand(2) * 7).cast("int").alias("b"), F.lit(4).alias("c"), F.lit(None).cast("double").alias("d"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.col("id")).alias("e"),
    ).cache()
    ask, names = [0.0, 0.25, 0.5, 0.9, 1.0], ["a", "b", "c", "d", "e"]
    by_rows = sorted(s.column_quantiles(rows, names, ask).collect())
    assert [r["variable"] for r in by_rows] == ["a", "b", "c", "e"]
    wide = []  # the rows that leave the wide table
    monkeypatch.setattr(s, "exact_quantiles", lambda *a: wide.append(a))
    for accuracy, group_rows in ((50_000, 100), (100, 1_000)):
        assert sorted(s.column_quantiles(rows, names, ask, None, group_rows, accuracy).collect()) == by_rows
    assert not wide
    s.column_quantiles(rows, names, ask, None, 10, 20)
    assert len(wide) == 1
    rows.unpersist()
