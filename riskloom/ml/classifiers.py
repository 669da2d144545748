"""Random forest and multilayer perceptron: training, tuning, scoring, persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import risk_label
from riskloom.ml import tree_tables
from riskloom.ml.features import assembler, class_weights, kept, scaler, stratified_folds, with_class_weights
from riskloom.operators.filters import at_threshold

# --- fixed values: model settings -----------------------------------------------
FOREST_TREES = 100
FOREST_DEPTH = 30  # the deepest tree Spark grows, for "no limit"
SEED = 42
GRID_TREES = [100, 200]
GRID_DEPTH = [10, 15, FOREST_DEPTH]
GRID_MIN_LEAF = [2, 5]
GRID_FOLDS = 3
HIDDEN_LAYERS = [32, 16]
MLP_ITERATIONS = 50
DECISION_CUT = 0.35
# --------------------------------------------------------------------------------

#: Labelled rows that the fit of a perceptron reads, about. Forests and scoring read all rows.
FIT_ROWS = 1_000_000
#: Rows up to which a forest is Spark ML's own, whose trees the driver holds; with more it is grown by ``tree_tables``.
#: A hundred deep trees of 8,000 rows with strong noise took more than 1.5 GB of the driver's memory.
DRIVER_ROWS = 2_000


def bounded_for_fit(train: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """All rows, or a repeatable sample of about ``rows`` of them with the classes in proportion."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    return train if total <= rows else train.sampleBy(label, {k: rows / total for k in counts if k is not None}, SEED)


def forest(label: str, weight: str | None = "peso", **settings) -> RandomForestClassifier:
    """A forest with √d features per split and optional row weights.

    The larger histogram budget splits more nodes per pass over the rows.
    """
    options = dict(numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, seed=SEED, maxMemoryInMB=1024) | settings
    model = RandomForestClassifier(
        featuresCol="features", labelCol=label, featureSubsetStrategy="sqrt", **options
    )
    return model.setWeightCol(weight) if weight else model


def _labelled(train: DataFrame, label: str) -> DataFrame:
    return train.where(F.col(label).isNotNull())


def _grows_as_table(train: DataFrame, label: str) -> bool:
    """Whether the driver should not hold the trees: many labelled rows of the classes 0 and 1."""
    sizes = {r[label]: r["n"] for r in _labelled(train, label).groupBy(label).agg(F.count("*").alias("n")).collect()}
    return sum(sizes.values()) > DRIVER_ROWS and set(sizes) == {0, 1}


def _growth(train: DataFrame, label: str, width: int, **settings) -> tree_tables.Growth:
    weights = {r[label]: r["peso"] for r in class_weights(train, label).collect()}
    options = dict(numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, minInstancesPerNode=1) | settings
    return tree_tables.Growth(
        options["numTrees"], options["maxDepth"], options["minInstancesPerNode"], (weights[0], weights[1]), width, SEED
    )


def train_forest(train: DataFrame, names: Sequence[str], label: str, **settings) -> PipelineModel:
    """Assemble, scale and fit a class-balanced forest on all labelled rows."""
    if settings.keys() <= {"numTrees", "maxDepth", "minInstancesPerNode"} and _grows_as_table(train, label):
        return _forest_as_table(train, names, label, **settings)
    weighted = with_class_weights(train, label)
    return Pipeline(stages=[assembler(names), scaler(), forest(label, **settings)]).fit(weighted)


def _forest_as_table(train: DataFrame, names: Sequence[str], label: str, **settings) -> PipelineModel:
    train = _labelled(train, label)
    prepared = Pipeline(stages=[assembler(names), scaler()]).fit(train)
    rows = prepared.transform(train)
    cuts = tree_tables.quantile_cuts(rows)
    trees = tree_tables.grow(tree_tables.binned(rows, label, cuts), _growth(train, label, len(names), **settings))
    return PipelineModel(stages=[*prepared.stages, tree_tables.TreeTableModel(trees, cuts)])


def tune_forest(
    train: DataFrame,
    names: Sequence[str],
    key: str,
    label: str,
    parallelism: int = 8,
    trees: Sequence[int] | None = None,
    depth: Sequence[int] | None = None,
) -> tuple[PipelineModel, CrossValidatorModel]:
    """Grid search by recall of class 1 over stratified folds, refitted on all training rows.

    Spark's trees have no least number of rows for a split, so settings that
    differ only in that number (5 or 10 rows) are one setting here. They would
    be the same model with 5 rows in a leaf; with 2 they would not.
    """
    if _grows_as_table(train, label):
        return _tune_as_table(_labelled(train, label), names, key, label, list(trees or GRID_TREES), list(depth or GRID_DEPTH))
    stages = Pipeline(stages=[assembler(names), scaler()])
    prepared = stages.fit(train)
    model = forest(label)
    grid = (
        ParamGridBuilder()
        .addGrid(model.numTrees, list(trees or GRID_TREES))
        .addGrid(model.maxDepth, list(depth or GRID_DEPTH))
        .addGrid(model.minInstancesPerNode, GRID_MIN_LEAF)
        .build()
    )
    recall = MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName="recallByLabel", metricLabel=1.0
    )
    search = CrossValidator(
        estimator=model, estimatorParamMaps=grid, evaluator=recall, numFolds=GRID_FOLDS,
        foldCol="fold", parallelism=parallelism, seed=SEED,
    )
    folded = stratified_folds(with_class_weights(train, label), key, label, GRID_FOLDS, SEED)
    with kept(prepared.transform(folded).select("features", label, "peso", "fold")) as rows:
        found = search.fit(rows)
    return PipelineModel(stages=[*prepared.stages, found.bestModel]), found


def _tune_as_table(
    train: DataFrame, names: Sequence[str], key: str, label: str, trees: list[int], depth: list[int]
) -> tuple[PipelineModel, CrossValidatorModel]:
    """The search on forests kept as tables: each fold and leaf size grows the largest forest once.

    Settings with fewer trees are its first ones, settings with less depth their upper parts, as if grown alone.
    """
    model = forest(label)
    builder = ParamGridBuilder().addGrid(model.numTrees, trees).addGrid(model.maxDepth, depth)
    grid = builder.addGrid(model.minInstancesPerNode, GRID_MIN_LEAF).build()
    with kept(stratified_folds(train, key, label, GRID_FOLDS, SEED)) as folded:
        prepared = Pipeline(stages=[assembler(names), scaler()]).fit(folded)
        rows = prepared.transform(folded)
        cuts = tree_tables.quantile_cuts(rows)
        table = tree_tables.binned(rows, label, cuts, "fold")
        scores: dict[tuple[int, int, int], list[float]] = {}
        for leaf in GRID_MIN_LEAF:
            growth = _growth(train, label, len(names), numTrees=max(trees), maxDepth=max(depth), minInstancesPerNode=leaf)
            for fold in range(GRID_FOLDS):
                grown = tree_tables.grow(table.where(F.col("fold") != fold), growth)
                found = tree_tables.recalls(table.where(F.col("fold") == fold), grown, len(names), trees, depth)
                for (size, level), recall in found.items():
                    scores.setdefault((size, level, leaf), []).append(recall)
    means = []
    for setting in grid:
        folds = scores[tuple(setting[p] for p in (model.numTrees, model.maxDepth, model.minInstancesPerNode))]
        means.append(sum(folds) / len(folds))
    chosen = {p.name: v for p, v in grid[means.index(max(means))].items()}
    best = tree_tables.grow(table, _growth(train, label, len(names), **chosen))
    search = CrossValidatorModel(tree_tables.TreeTableModel(best, cuts), means)
    search._set(estimatorParamMaps=grid)
    return PipelineModel(stages=[*prepared.stages, search.bestModel]), search


def search_results(found: CrossValidatorModel, df: DataFrame) -> DataFrame:
    """Mean recall of each setting, best first."""
    rows = []
    for setting, score in zip(found.getEstimatorParamMaps(), found.avgMetrics):
        values = {p.name: v for p, v in setting.items()}
        rows.append((values["numTrees"], values["maxDepth"], values["minInstancesPerNode"], float(score)))
    table = df.sparkSession.createDataFrame(rows, "arboles int, profundidad int, min_hoja int, recall double")
    return table.orderBy(F.col("recall").desc(), "arboles", "profundidad", "min_hoja")


def train_perceptron(train: DataFrame, names: Sequence[str], label: str) -> PipelineModel:
    """Assemble, scale and fit a perceptron with two hidden layers."""
    network = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=[len(names), *HIDDEN_LAYERS, 2],
        maxIter=MLP_ITERATIONS, seed=SEED,
    )
    return Pipeline(stages=[assembler(names), scaler(), network]).fit(bounded_for_fit(train, label))


def loss_curve(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(iteration, loss) of a freshly trained perceptron."""
    history = model.stages[-1].summary().objectiveHistory
    return df.sparkSession.createDataFrame(
        [(i, float(x)) for i, x in enumerate(history)], "iteracion int, perdida double"
    )


def score(model: Model, df: DataFrame, threshold: float = DECISION_CUT) -> DataFrame:
    """Rows with the model's class, the probability of class 1, the class at ``threshold`` and a risk label."""
    scored = model.transform(df)
    return scored.withColumn("probabilidad", vector_to_array("probability")[1]).select(
        *df.columns,
        F.col("prediction").cast("int").alias("prediccion"),
        "probabilidad",
        at_threshold(F.col("probabilidad"), threshold).alias("prediccion_corte"),
        risk_label("prediction").alias("riesgo"),
    )


def probability_rows(scored: DataFrame, key: str) -> DataFrame:
    """Two rows per scored row: the probability of each class in %."""
    return scored.select(
        key,
        F.expr("stack(2, 'No Default', (1 - probabilidad) * 100, 'Default', probabilidad * 100) as (clase, prob)"),
    )


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Impurity importances by feature name, largest first."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    table = df.sparkSession.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "variable string, importancia double"
    )
    return table.orderBy(F.col("importancia").desc(), "variable")


def importance_summary(importance: DataFrame) -> DataFrame:
    """Number of variables, largest and mean importance."""
    return importance.agg(
        F.count("*").alias("variables"),
        F.max("importancia").alias("importancia_maxima"),
        F.avg("importancia").alias("importancia_media"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Names, scaler and model as one artifact."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
