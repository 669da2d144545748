import math
import random

import numpy as np
import pytest
from helpers import values
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.ml import classifiers, clustering, features, lloyd, metrics
from riskloom.session import scratch_path
from riskloom.sources import csvfiles


@pytest.fixture(scope="module")
def blobs(spark):
    """Three well separated groups in 4 dimensions, sizes 60, 40, 20; class 1 is the third and part of the second."""
    rng = random.Random(5)
    rows, key = [], 0
    for g, n in enumerate((60, 40, 20)):
        for i in range(n):
            key += 1
            x = [10.0 * g + rng.gauss(0, 1) for _ in range(4)]
            rows.append((key, int(g == 2 or (g == 1 and i < 5)), *x))
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double, d double").repartition(3)


NAMES = ["a", "b", "c", "d"]


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 4), (2.0, 4), (3.0, 4)], "x double, k int")
    got = values(features.standardize(df, ["x", "k"]), "x", "k")
    assert [x for x, _ in got] == pytest.approx([-math.sqrt(1.5), 0.0, math.sqrt(1.5)])
    assert [k for _, k in got] == [0.0, 0.0, 0.0]
    arrays = df.select(F.array("x", "k").alias("v"))
    wide = sorted(tuple(r["features"]) for r in features.standardize_array(arrays, "v").collect())
    assert [x for x, _ in wide] == pytest.approx([-math.sqrt(1.5), 0.0, math.sqrt(1.5)])
    train = df.where("x < 3")
    other = features.standardize(df, ["x"], fit_on=train)
    assert max(r["x"] for r in other.collect()) == pytest.approx(3.0)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert dict(values(features.class_weights(df, "y"), "y", "peso")) == {0: pytest.approx(2 / 3), 1: 2.0}


def test_holdout_is_exact_and_repeatable(blobs):
    train, test = features.stratified_holdout(blobs, "id", "y")
    per_class = dict(values(blobs.groupBy("y").count(), "y", "count"))
    got = dict(values(test.groupBy("y").count(), "y", "count"))
    assert got == {y: math.floor(n * 0.2 + 0.5) for y, n in per_class.items()}
    assert train.join(test, "id").count() == 0 and train.count() + test.count() == 120
    again = features.stratified_holdout(blobs.repartition(7), "id", "y")[1]
    assert values(again, "id") == values(test, "id")
    folds = values(features.stratified_folds(blobs, "id", "y", 3).groupBy("fold").count(), "fold", "count")
    assert [f for f, _ in folds] == [0, 1, 2] and sum(n for _, n in folds) == 120


def test_fill_with_means(spark):
    reference = spark.createDataFrame([(10.0, 1.0, 5.0), (20.0, 3.0, 7.0)], "a double, b double, c double")
    given = spark.createDataFrame([(100.0, None)], "a double, b double")
    row = features.fill_with_means(given, ["a", "b", "c"], reference).first()
    assert (row["a"], row["b"], row["c"]) == (100.0, 2.0, 6.0)


def test_kmeans_finds_the_groups(spark, blobs):
    rows = features.assembler(NAMES, "features").transform(blobs).cache()
    model = clustering.fit_kmeans(rows, restarts=3)
    got = clustering.assign(model, rows)
    assert values(got.groupBy("cluster").count(), "cluster", "count") == [(0, 60), (1, 40), (2, 20)]
    scan = clustering.scan_k(rows, range(2, 5), restarts=2).orderBy("k").collect()
    assert scan[0]["inercia"] > scan[1]["inercia"] > scan[2]["inercia"]
    assert max(scan, key=lambda r: r["silueta"])["k"] == 3
    predicted = clustering.predict_by_majority(got, "cluster", "y")
    assert metrics.classification_report(predicted, "y", "prediccion").where("clase = 'accuracy'").first()["f1"] == pytest.approx(115 / 120)
    table = clustering.centre_table(model, spark, NAMES)
    centres = table.select(F.col("cluster").alias("k"), F.array(*NAMES).alias("centro"))
    direct = clustering.nearest_centre(blobs.withColumn("v", F.array(*NAMES)), "v", centres, "k")
    assert values(direct, "id", "cluster") == values(got, "id", "cluster")
    rows.unpersist()


@pytest.mark.parametrize("block", [1, 3, 1_000])
def test_nearest_centre_equals_brute_force(spark, blobs, block):
    rows = blobs.select("id", (F.col("id") % 4).alias("g"), F.array(*NAMES).alias("v"))
    centres = clustering.mean_centres(rows, "g", "v")
    known = {r["g"]: np.array(r["centro"]) for r in centres.collect()}
    for r in clustering.nearest_centre(rows, "v", centres, "g", block).collect():
        gaps = {g: float(((np.array(r["v"]) - c) ** 2).sum()) for g, c in known.items()}
        assert r["cluster"] == min(gaps, key=lambda g: (gaps[g], g))
        assert r["distancia2"] == pytest.approx(min(gaps.values()))


def test_fits_read_a_bounded_sample(spark):
    rows = spark.range(10_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    assert classifiers.bounded_for_fit(rows, "y", 20_000) is rows
    sample = classifiers.bounded_for_fit(rows, "y", 1_000)
    assert 800 < sample.count() < 1_200
    assert 0.05 < sample.agg(F.avg("y")).first()[0] < 0.15
    assert sample.collect() == classifiers.bounded_for_fit(rows, "y", 1_000).collect()


def test_pca(blobs):
    rows = features.standardize_array(blobs.withColumn("v", F.array(*NAMES)), "v").cache()
    model = clustering.fit_pca(rows)
    scored = clustering.pca_scores(model, rows).select("id", "pca1", "pca2", F.lit(0).alias("cluster"), "y")
    x = np.array([r["features"].toArray() for r in rows.collect()])
    s = np.linalg.svd(x, compute_uv=False)
    assert model.explainedVariance.toArray() == pytest.approx((s**2 / (s**2).sum())[:2])
    assert scored.agg(F.var_pop("pca1")).first()[0] == pytest.approx(s[0] ** 2 / len(x))
    view = clustering.cluster_view(scored, "id", "cluster", "y")
    assert {r["estado"] for r in view.collect()} == {"No Default", "Default"}
    rows.unpersist()


def test_forest_scores_saves_and_ranks(spark, blobs):
    clean = blobs.withColumn("y", (F.col("a") > 15).cast("int"))  # the third group, far from the others
    train, test = features.stratified_holdout(clean, "id", "y")
    model = classifiers.train_forest(train, NAMES, "y", numTrees=10)
    scored = classifiers.score(model, test)
    assert scored.where("prediccion_corte <> cast(probabilidad >= 0.35 as int)").count() == 0
    assert metrics.roc_auc(scored, "y", "probabilidad").first()[0] == 1.0
    path = scratch_path(spark, "model")
    classifiers.save_model(model, path)
    again = classifiers.score(classifiers.load_model(path), test)
    assert values(again, "id", "probabilidad") == values(scored, "id", "probabilidad")
    table = classifiers.feature_importance(model, train)
    assert sum(r["importancia"] for r in table.collect()) == pytest.approx(1.0)
    assert tuple(classifiers.importance_summary(table).first())[::2] == (4, pytest.approx(0.25))
    pairs = classifiers.probability_rows(scored, "id")
    assert pairs.groupBy("id").agg(F.sum("prob").alias("s")).where("abs(s - 100) > 1e-9").count() == 0


def test_grid_search(blobs, monkeypatch):
    monkeypatch.setattr(classifiers, "GRID_TREES", [3])
    monkeypatch.setattr(classifiers, "GRID_DEPTH", [2, 4])
    model, found = classifiers.tune_forest(blobs, NAMES, "id", "y")
    table = classifiers.search_results(found, blobs).collect()
    assert len(table) == 4 and table[0]["recall"] == max(r["recall"] for r in table)
    assert classifiers.score(model, blobs).count() == 120


def test_perceptron(blobs):
    model = classifiers.train_perceptron(blobs, NAMES, "y")
    losses = [r["perdida"] for r in classifiers.loss_curve(model, blobs).orderBy("iteracion").collect()]
    assert losses[-1] < losses[0]
    assert classifiers.score(model, blobs, 0.5).where("prediccion <> prediccion_corte").count() == 0


def test_feature_csv(spark, blobs):
    rows = features.assembler(NAMES, "features").transform(blobs)
    path = scratch_path(spark, "csv")
    csvfiles.write_features(rows, path, "features", NAMES, "y")
    back = spark.read.schema("a double, b double, c double, d double, y int").option("header", True).csv(path)
    assert back.exceptAll(blobs.select(*NAMES, "y")).count() == 0 and back.count() == 120


def test_models_fitted_together_equal_models_fitted_alone(spark, monkeypatch):
    """Whole rounds as well: the sample that starts settle on is a part of the rows."""
    monkeypatch.setattr(lloyd, "START_ROWS", 60)
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(c, 1.0, (70, 3)) for c in (0, 3, 5)])
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>").repartition(3)
    rows = rows.select(array_to_vector("v").alias("features")).cache()
    settings = [(k, seed) for k in (2, 3, 5) for seed in (1, 2)]
    together = lloyd.fit_all(rows, settings)
    for model, setting in zip(together, settings, strict=True):
        (alone,) = lloyd.fit_all(rows, [setting])
        assert (model.k, model.seed) == setting and model.sizes == alone.sizes
        assert np.allclose(model.centres, alone.centres) and model.inertia == pytest.approx(alone.inertia)
        gaps = ((points[:, None] - model.centres) ** 2).sum(2)
        assert model.inertia == pytest.approx(gaps.min(1).sum())
        assert model.sizes == tuple(np.bincount(gaps.argmin(1), minlength=len(model.centres)))
        means = np.array([points[gaps.argmin(1) == i].mean(0) for i in range(len(model.centres))])
        assert ((means - model.centres) ** 2).sum() <= 2 * lloyd.TOLERANCE * points.var(0).mean()
        assert list(model.sizes) == sorted(model.sizes, reverse=True)
    widths = lloyd.silhouettes(rows, together)
    assert widths == pytest.approx([clustering.silhouette(clustering.assign(m, rows)) for m in together])
    rows.unpersist()


def test_parts_of_a_large_table_come_before_all_rows(spark, monkeypatch):
    """Rounds over parts that grow leave few rounds over all rows; these go on until no model moves."""
    monkeypatch.setattr(lloyd, "START_ROWS", 20)
    monkeypatch.setattr(lloyd, "GROWTH", 4)
    draw = np.random.default_rng(3)
    points = np.concatenate([draw.normal(c, 1.0, (500, 3)) for c in (0, 2, 4)])
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "v array<double>").select(array_to_vector("v").alias("features"))
    sizes, sums = [], lloyd._sums

    def seen(packed, models, extra):
        found = sums(packed, models, extra)
        sizes.append(int(found[0].sum()) // len(models))
        return found

    monkeypatch.setattr(lloyd, "_sums", seen)
    models = lloyd.fit_all(rows, [(3, 1), (3, 2)])
    assert sizes == sorted(sizes) and sizes[-1] == 1500 and len({n for n in sizes if n < 750}) >= 2
    for model in models:
        gaps = ((points[:, None] - model.centres) ** 2).sum(2)
        means = np.array([points[gaps.argmin(1) == i].mean(0) for i in range(3)])
        assert ((means - model.centres) ** 2).sum() <= 2 * lloyd.TOLERANCE * points.var(0).mean() and sum(model.sizes) == 1500


def test_kmeans_of_few_and_of_no_rows(spark):
    rows = spark.createDataFrame([([1.0, 2.0],)] * 4 + [([3.0, 2.0],)], "v array<double>")
    rows = rows.select(array_to_vector("v").alias("features"))
    model = clustering.fit_kmeans(rows, k=5)
    assert model.sizes == (4, 1) and model.inertia == 0
    assert lloyd.fit_all(rows.limit(0), [(2, 1)]) == []
    assert clustering.scan_k(rows.limit(0)).count() == 0


def test_segments_save_and_load(spark, blobs):
    rows = blobs.withColumn("v", F.array(*NAMES))
    scaling = features.vector_scaling(rows, "v")
    model = clustering.fit_kmeans(features.scale_array(rows, "v", scaling))
    path = scratch_path(spark, "segments")
    clustering.save_segments(model, scaling, spark, path)
    again, its_scaling = clustering.load_segments(spark, path)
    first = clustering.assign(model, features.scale_array(rows, "v", scaling))
    second = clustering.assign(again, features.scale_array(rows, "v", its_scaling))
    assert values(first, "id", "cluster") == values(second, "id", "cluster")
    assert again.sizes == model.sizes and again.inertia == model.inertia


def test_cluster_profile(spark):
    rows = spark.createDataFrame([(0, 10.0, 1), (0, 20.0, 0), (1, 5.0, 1), (0, 31.0, 0)], "cluster int, limite double, y int")
    got = [tuple(r) for r in clustering.cluster_profile(rows, ["limite"], "y").collect()]
    assert got == [(0, 3, 20.33, 33.33), (1, 1, 5.0, 100.0)]


def test_points_travel_in_small_blocks(spark):
    """An Arrow batch takes 10,000 blocks: with blocks of 2,048 rows it held all rows of a task."""
    rows = spark.range(0, 5_000, 1, 2).select(array_to_vector(F.array(*[(F.col("id") + i).cast("double") for i in range(23)])).alias("features"))
    packed = lloyd._packed(lloyd._points(rows, "features"))
    blocks = [np.frombuffer(r["block"]).reshape(-1, 23) for r in packed.collect()]
    assert max(b.nbytes for b in blocks) * 10_000 < 32 << 20
    assert np.concatenate(blocks)[:, 0].tolist() == list(range(5_000))
    counts, _, sums = lloyd._sums(packed, [np.zeros((1, 23))], lambda rows, places, squares: squares)
    assert counts.tolist() == [5_000.0] and sums[0, 1] == 5_000 * 4_999 / 2 + 5_000
    assert lloyd._packed(lloyd._points(rows.where("false"), "features")).count() == 0
