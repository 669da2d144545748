"""Fitted models. Their rows depend on the solver, so SQL can check only fixed parts of some of them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.ml import classifiers, clustering, features, metrics
from riskloom.plans import binding as b
from riskloom.plans.registry import query
from riskloom.session import scratch_path
from riskloom.sources import csvfiles, documents

_DIM = 64
_NAMES = [f"x{i}" for i in range(_DIM)]


def _rows(spark, sf_dir):
    """Vectors as named columns, a two-class target from the label."""
    rows = b.table(spark, sf_dir, "embeddings")
    cells = F.col("embedding").cast("array<double>")
    return rows.select(
        "vec_id", (F.col("label") >= 7).cast("int").alias("target"), *[cells[i].alias(n) for i, n in enumerate(_NAMES)]
    )


def _scaled(spark, sf_dir):
    """The same rows as one standardised vector (population deviation)."""
    rows = b.table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") >= 7).cast("int").alias("target"), "embedding"
    )
    return features.standardize_array(rows, "embedding").drop("embedding")


def _split(spark, sf_dir):
    return features.stratified_holdout(_rows(spark, sf_dir), "vec_id", "target", 0.2)


@query()
def kmeans_scan(spark, sf_dir):
    """Inertia and silhouette for k = 2..10, ten restarts each."""
    with features.kept(_scaled(spark, sf_dir)) as rows:
        return clustering.scan_k(rows)


@query()
def kmeans_assign(spark, sf_dir):
    """Cluster of every row, clusters numbered by size."""
    with features.kept(_scaled(spark, sf_dir)) as rows:
        model = clustering.fit_kmeans(rows)
    return clustering.assign(model, _scaled(spark, sf_dir)).select("vec_id", "cluster")


@query()
def kmeans_report(spark, sf_dir):
    """Clusters evaluated as a classifier through their majority class."""
    with features.kept(_scaled(spark, sf_dir)) as rows:
        model = clustering.fit_kmeans(rows)
    assigned = clustering.assign(model, _scaled(spark, sf_dir))
    predicted = clustering.predict_by_majority(assigned, "cluster", "target")
    return metrics.classification_report(predicted, "target", "prediccion")


@query()
def kmeans_centres(spark, sf_dir):
    with features.kept(_scaled(spark, sf_dir)) as rows:
        model = clustering.fit_kmeans(rows)
    return clustering.centre_table(model, spark, _NAMES)


@query()
def pca_2d(spark, sf_dir):
    """Two component scores, cluster and class label per row."""
    with features.kept(_scaled(spark, sf_dir)) as rows:
        model, components = clustering.fit_kmeans(rows), clustering.fit_pca(rows)
    scored = clustering.pca_scores(components, clustering.assign(model, _scaled(spark, sf_dir)))
    return clustering.cluster_view(scored, "vec_id", "cluster", "target")


@query()
def pca_explained_variance(spark, sf_dir):
    """Share of the variance (%) in each of two components and in both."""
    model = clustering.fit_pca(_scaled(spark, sf_dir))
    first, second = (float(v) * 100 for v in model.explainedVariance.toArray())
    return spark.createDataFrame([(first, second, first + second)], "pc1 double, pc2 double, total double")


@query()
def rf_train_score(spark, sf_dir):
    """Forest trained on 80 %, scored on the rest: class, probability, class at the lower cut."""
    train, test = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_forest(rows, _NAMES, "target")
    return classifiers.score(model, test).drop(*_NAMES)


@query()
def rf_metrics(spark, sf_dir):
    """Hold-out counts and metrics of the forest at the model's cut and at 0.35."""
    train, test = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_forest(rows, _NAMES, "target")
    scored = classifiers.score(model, test)
    return metrics.threshold_impact(scored, "target", "probabilidad", [0.5, classifiers.DECISION_CUT])


@query()
def rf_probability_rows(spark, sf_dir):
    """Both class probabilities of each scored row."""
    train, test = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_forest(rows, _NAMES, "target")
    return classifiers.probability_rows(classifiers.score(model, test), "vec_id")


@query()
def rf_score_missing_inputs(spark, sf_dir):
    """Rows with six given inputs, the others filled by the training means, then scored."""
    train, test = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_forest(rows, _NAMES, "target")
    partial = test.select("vec_id", *_NAMES[:6])
    filled = features.fill_with_means(partial, _NAMES, train)
    return classifiers.score(model, filled).select("vec_id", "prediccion", "probabilidad", "riesgo")


@query()
def rf_grid_search(spark, sf_dir):
    """Mean recall of every setting over three stratified folds, best first."""
    train, _ = _split(spark, sf_dir)
    _, found = classifiers.tune_forest(train, _NAMES, "vec_id", "target")
    return classifiers.search_results(found, train)


@query()
def feature_importance(spark, sf_dir):
    """The fifteen largest importances."""
    train, _ = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_forest(rows, _NAMES, "target")
    return classifiers.feature_importance(model, train).limit(15)


@query()
def importance_summary(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_forest(rows, _NAMES, "target")
    return classifiers.importance_summary(classifiers.feature_importance(model, train))


@query()
def mlp_train_score(spark, sf_dir):
    """Perceptron trained on 80 %, scored on the rest."""
    train, test = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_perceptron(rows, _NAMES, "target")
    return classifiers.score(model, test, 0.5).drop(*_NAMES)


@query()
def mlp_loss_curve(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_perceptron(rows, _NAMES, "target")
        return classifiers.loss_curve(model, rows)


@query(
    """SELECT CAST(floor(count(*) FILTER (WHERE label >= 7) * 0.2::DOUBLE + 0.5::DOUBLE)
    + floor(count(*) FILTER (WHERE label < 7) * 0.2::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS filas FROM embeddings"""
)
def model_round_trip(spark, sf_dir):
    """A saved and reloaded forest gives every hold-out row the same class as the one in memory."""
    train, test = _split(spark, sf_dir)
    with features.kept(train) as rows:
        model = classifiers.train_forest(rows, _NAMES, "target")
    path = scratch_path(spark, "forest")
    classifiers.save_model(model, path)
    again = classifiers.load_model(path)
    first = classifiers.score(model, test).select("vec_id", "prediccion", "probabilidad")
    second = classifiers.score(again, test).select("vec_id", "prediccion", "probabilidad")
    return first.join(second, ["vec_id", "prediccion", "probabilidad"]).agg(F.count("*").alias("filas"))


def _scaled_sql(deviation: str) -> str:
    cells = ", ".join(
        f"round((embedding[{i}]::DOUBLE - avg(embedding[{i}]::DOUBLE) OVER ()) / "
        f"{deviation}(embedding[{i}]::DOUBLE) OVER (), 6) + 0 AS x{i - 1}"
        for i in range(1, _DIM + 1)
    )
    return f"SELECT vec_id, {cells} FROM embeddings"


@query(_scaled_sql("stddev_samp"))
def csv_feature_sink(spark, sf_dir):
    """Scaled features written as CSV with their names and read back."""
    prepared = Pipeline(stages=[features.assembler(_NAMES), features.scaler()])
    rows = _rows(spark, sf_dir)
    path = scratch_path(spark, "features")
    csvfiles.write_features(prepared.fit(rows).transform(rows), path, "features", _NAMES, "vec_id")
    schema = ", ".join([*[f"{n} double" for n in _NAMES], "vec_id bigint"])
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.select("vec_id", *[(F.round(c, 6) + 0.0).alias(c) for c in _NAMES])


@query(_scaled_sql("stddev_pop"))
def standardize_vectors(spark, sf_dir):
    """Whole vectors scaled by the population deviation of each part."""
    cells = vector_to_array("features")
    return _scaled(spark, sf_dir).select(
        "vec_id", *[(F.round(cells[i], 6) + 0.0).alias(f"x{i}") for i in range(_DIM)]
    )


@query()
def experiment_log(spark, sf_dir):
    """A clustering run recorded as a nested document, read back and flattened."""
    with features.kept(_scaled(spark, sf_dir)) as rows:
        model = clustering.fit_kmeans(rows)
        found = clustering.silhouette(clustering.assign(model, rows))
        total = rows.count()
    path = scratch_path(spark, "experiments")
    documents.append_experiment(
        spark,
        path,
        "2024-01-31T00:00:00",
        "K-Means",
        {"n_clusters": 3, "random_state": 42, "n_init": 10, "max_iter": 300},
        {
            "silhouette_score": round(found, 4),
            "inertia": round(model.inertia, 2),
            "total_registros_procesados": total,
        },
    )
    return documents.flatten_documents(documents.read_documents(spark, path))
