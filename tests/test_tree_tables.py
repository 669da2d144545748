"""Forests kept as tables: counted splits, dealt subtrees, scores, grid search."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from riskloom.ml import classifiers, features, metrics, tree_tables
from riskloom.session import scratch_path

NAMES = ["a", "b", "c"]


@pytest.fixture
def rows(spark, monkeypatch):
    """Class 1 lies in two corners of the plane of a and b; c is noise. Several nodes are split over all tasks."""
    monkeypatch.setattr(classifiers, "DRIVER_ROWS", 100)
    monkeypatch.setattr(tree_tables, "SUBTREE_ROWS", 150)
    monkeypatch.setattr(tree_tables, "DEALT_TREES", 3)
    monkeypatch.setattr(tree_tables, "SENT_TREES", 2)
    cells = [F.rand(i + 1).alias(n) for i, n in enumerate(NAMES)]
    table = spark.range(0, 1_000, 1, 4).select("id", *cells)
    table = table.withColumn("y", ((F.col("a") > 0.5) != (F.col("b") > 0.3)).cast("int")).cache()
    yield table
    table.unpersist()


def test_forest_as_table(spark, rows):
    train, test = features.stratified_holdout(rows, "id", "y")
    model = classifiers.train_forest(train, NAMES, "y", numTrees=20)
    assert isinstance(model.stages[-1], tree_tables.TreeTableModel)
    scored = classifiers.score(model, test)
    assert scored.columns[:5] == test.columns and scored.count() == test.count()
    assert metrics.roc_auc(scored, "y", "probabilidad").first()[0] > 0.97
    assert scored.where("prediccion <> cast(probabilidad > 0.5 as int)").count() == 0
    importance = {r["variable"]: r["importancia"] for r in classifiers.feature_importance(model, train).collect()}
    assert sum(importance.values()) == pytest.approx(1.0) and importance["c"] < min(importance["a"], importance["b"])
    path = scratch_path(spark, "forest")
    classifiers.save_model(model, path)
    again = classifiers.score(classifiers.load_model(path), test)
    assert sorted(again.select("id", "probabilidad").collect()) == sorted(scored.select("id", "probabilidad").collect())


def test_driver_holds_the_trees_of_few_rows_only(spark):
    """100 trees of 8,000 noisy rows were Spark ML's own, and took the driver's memory."""
    rows = spark.range(0, 3_000, 1, 2).select("id", F.rand(1).alias("a"), (F.rand(2) > 0.5).cast("int").alias("y"))
    for table, kind in ((rows, tree_tables.TreeTableModel), (rows.where("id < 500"), RandomForestClassificationModel)):
        assert isinstance(classifiers.train_forest(table, ["a"], "y", numTrees=2, maxDepth=5).stages[-1], kind)


def test_scores_pass_no_trees_through_the_driver(rows, monkeypatch):
    """Several slices of rows and blocks of trees; equal rows and no rows. The trees were sent to all tasks as broadcasts."""
    model = classifiers.train_forest(rows, NAMES, "y", numTrees=5).stages[-1]
    monkeypatch.setattr(tree_tables, "CHUNK", 300)
    monkeypatch.setattr(rows.sparkSession.sparkContext, "broadcast", None)
    vectors = features.assembler(NAMES, "features").transform(rows.unionAll(rows.where("id < 100")))
    scored = model.transform(vectors)
    assert scored.columns == [*vectors.columns, "probability", "prediction"]
    held = scored.select("id", *NAMES, F.col("probability").cast("string").alias("p"), "prediction").toPandas()
    cells = np.stack([np.searchsorted(c, held[n]) for n, c in zip(NAMES, model.cuts, strict=True)], 1)
    start = np.zeros(len(held), np.int64)
    chance = sum(c[tree_tables.walk(cells, start, f, k, left)].astype(float) for f, k, left, c in _trees(model.trees)) / 5
    assert len(held) == 1_100 and [float(x[1:-1].split(",")[1]) for x in held["p"]] == pytest.approx(chance.tolist())
    assert held["prediction"].tolist() == (chance > 0.5).astype(float).tolist()
    assert model.transform(vectors.where("id < 0")).count() == 0


def test_each_action_on_scored_rows_does_not_walk_the_trees_again(rows):
    model = classifiers.train_forest(rows, NAMES, "y", numTrees=2)
    plan = classifiers.score(model, rows)._jdf.queryExecution().executedPlan().toString()
    assert "Parquet" in plan and "Python" not in plan and "CoGroup" not in plan


def _trees(trees):
    kinds = {"feature": np.uint8, "cut": np.uint8, "left": np.int32, "chance": np.float32}
    return [[np.frombuffer(r[n], t) for n, t in kinds.items()] for r in trees.orderBy("tree").collect()]


@pytest.mark.parametrize("subtree_rows", [150, 10_000])
def test_every_leaf_holds_the_drawn_rows_that_reach_it(rows, monkeypatch, subtree_rows):
    """With upper nodes split by counts and with whole trees finished by one group."""
    monkeypatch.setattr(tree_tables, "SUBTREE_ROWS", subtree_rows)
    vectors = features.assembler(NAMES, "features").transform(rows)
    cuts = tree_tables.quantile_cuts(vectors)
    table = tree_tables.binned(vectors, "y", cuts)
    growth = tree_tables.Growth(4, 30, 1, (1.0, 2.0), 3, 7)
    held = table.toArrow()
    ids, y = held["id"].to_numpy(), held["y"].to_numpy()
    cells = np.frombuffer(b"".join(held["bins"].to_pylist()), np.uint8).reshape(-1, 3)
    point = {r["id"]: r for r in rows.withColumn("id", F.monotonically_increasing_id()).collect()}
    for i, n in enumerate(NAMES):
        assert cells[:, i].tolist() == [int(np.searchsorted(cuts[i], point[k][n])) for k in ids.tolist()]
    for tree, (feature, cut, left, chance) in enumerate(_trees(tree_tables.grow(table, growth))):
        times = tree_tables.times_drawn(ids, tree, 7).astype(float)
        leaf = tree_tables.walk(cells, np.zeros(len(ids), np.int64), feature, cut, left)
        assert (left[leaf] == 0).all()
        ones, zeros = np.bincount(leaf, times * y * 2, len(left)), np.bincount(leaf, times * (1 - y), len(left))
        used = np.flatnonzero(ones + zeros)
        assert set(used) == set(np.flatnonzero(left == 0))  # no leaf without rows
        assert chance[used] == pytest.approx(ones[used] / (ones + zeros)[used], abs=1e-6)


def test_settings_are_parts_of_the_largest_forest(rows):
    vectors = features.assembler(NAMES, "features").transform(rows)
    table = tree_tables.binned(vectors, "y", tree_tables.quantile_cuts(vectors))

    def trees(count, depth):
        return tree_tables.grow(table, tree_tables.Growth(count, depth, 2, (1.0, 1.0), 3, 7))

    together = tree_tables.recalls(table, trees(5, 9), 3, [2, 5], [3, 9])
    alone = {(n, d): tree_tables.recalls(table, trees(n, d), 3, [n], [d])[n, d] for n in (2, 5) for d in (3, 9)}
    assert together == alone and together[5, 9] > 0.9


def test_grid_search_as_table(rows, monkeypatch):
    monkeypatch.setattr(classifiers, "GRID_TREES", [2, 4])
    monkeypatch.setattr(classifiers, "GRID_DEPTH", [2, 6])
    model, found = classifiers.tune_forest(rows, NAMES, "id", "y")
    table = classifiers.search_results(found, rows).collect()
    assert len(table) == 8 and table[0]["recall"] == max(r["recall"] for r in table) > 0.8
    assert {(r["arboles"], r["profundidad"], r["min_hoja"]) for r in table} == {(n, d, m) for n in (2, 4) for d in (2, 6) for m in (2, 5)}
    assert classifiers.score(model, rows).where("prediccion = y").count() > 800


def test_forests_read_all_rows(spark, monkeypatch):
    """Fits took a part of the rows beyond ``FIT_ROWS``: here the leaves' classes show which rows took part."""
    monkeypatch.setattr(classifiers, "DRIVER_ROWS", 100)
    monkeypatch.setattr(classifiers, "FIT_ROWS", 300)
    rows = spark.range(0, 1_000, 1, 4).select("id", F.rand(1).alias("a"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    rows = rows.unionAll(spark.createDataFrame([(5_000, 0.5, None)], rows.schema)).cache()
    binned = []
    monkeypatch.setattr(tree_tables, "binned", lambda *a, real=tree_tables.binned: binned.append(real(*a)) or binned[-1])
    model = classifiers.train_forest(rows, ["a"], "y", numTrees=2, maxDepth=3)
    assert isinstance(model.stages[-1], tree_tables.TreeTableModel)
    monkeypatch.setattr(classifiers, "GRID_TREES", [2])
    monkeypatch.setattr(classifiers, "GRID_DEPTH", [2])
    classifiers.tune_forest(rows, ["a"], "id", "y")
    assert [(t.count(), t.where("y = 1").count()) for t in binned] == [(1_000, 250), (1_000, 250)]
    rows.unpersist()


@pytest.mark.parametrize("chunk", [500, 50_000])
def test_cuts_are_quantiles_of_all_rows(spark, monkeypatch, chunk):
    """They were those of 10,000 rows. Skew, ties, few values, one value, and a value only in the last tasks' rows."""
    monkeypatch.setattr(tree_tables, "CHUNK", chunk)
    monkeypatch.setattr(tree_tables, "SHOWN", 40)
    i = F.col("id")
    columns = [F.rand(3), F.exp(F.rand(4) * 20), F.round(F.rand(5) * 40), (i % 3).cast("double"), F.lit(2.0), F.greatest(i - 11_000, F.lit(0)).cast("double")]
    table = spark.range(0, 12_000, 1, 5).select("id", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).cache()
    found = tree_tables.quantile_cuts(features.assembler([f"c{k}" for k in range(6)], "features").transform(table))
    held = table.toPandas()
    for k, cuts in enumerate(found):
        values = held[f"c{k}"].to_numpy()
        ends = np.quantile(values, np.arange(1, 32) / 32, method="lower")
        assert cuts.tolist() == np.unique(ends[ends < values.max()]).tolist()
    table.unpersist()


def test_trees_in_parts_are_the_whole_trees(spark, rows, monkeypatch):
    """Beyond ``WHOLE_ROWS`` nobody holds a whole tree: the same chances, recalls and importances, also after reloading."""
    vectors = features.assembler(NAMES, "features").transform(rows)
    cuts = tree_tables.quantile_cuts(vectors)
    table = tree_tables.binned(vectors, "y", cuts)
    growth = tree_tables.Growth(5, 9, 1, (1.0, 2.0), 3, 7)
    whole = tree_tables.grow(table, growth)
    monkeypatch.setattr(tree_tables, "WHOLE_ROWS", 100)
    monkeypatch.setattr(tree_tables, "CHUNK", 300)
    monkeypatch.setattr(tree_tables, "LARGE_SUBTREE_ROWS", 60)  # rows that go to one part are dealt to several tasks
    monkeypatch.setattr(tree_tables, "DEALT_BYTES", 11_000)  # two trees at a time
    monkeypatch.setattr(tree_tables, "COUNT_BYTES", 4_096)  # four nodes at a time
    parts = tree_tables.grow(table, growth)
    assert parts.count() > 15 and parts.where("node >= 0 and octet_length(cut) > 151 * 2").count() == 0
    models = [tree_tables.TreeTableModel(trees, cuts) for trees in (whole, parts)]
    path = scratch_path(spark, "parts")
    models[1].save(path)
    models.append(tree_tables.TreeTableModel.load(path))
    scores = [{r["id"]: r["p"] for r in m.transform(vectors).selectExpr("id", "cast(probability as string) p").collect()} for m in models]
    chances = [[float(s[i][1:-1].split(",")[1]) for i in sorted(s)] for s in scores]
    assert len(chances[0]) == 1_000 and chances[1] == pytest.approx(chances[0], abs=1e-12) and scores[1] == scores[2]
    assert models[1].featureImportances.toArray() == pytest.approx(models[0].featureImportances.toArray())
    assert models[1].transform(vectors.where("id < 0")).count() == 0
    recalls = [tree_tables.recalls(table, trees, 3, [2, 5], [1, 3, 9]) for trees in (whole, parts)]
    assert recalls[0] == recalls[1] and recalls[0][5, 9] > 0.9
