"""Statistics, evaluation metrics and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.ml import clustering, features, metrics
from riskloom.operators import profile, reshape, sketches
from riskloom.operators import star as star_ops
from riskloom.plans import binding as b
from riskloom.plans.registry import query
from riskloom.schemas import BILL_COLUMNS, PAID_COLUMNS, PAY_COLUMNS
from riskloom.session import scratch_path

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_values(cast: str = "DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value FROM lineitem" for c in _LINE)


def _rounded(df, digits: dict[str, int]):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    f"""SELECT variable, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50,
  round(quantile_cont(value, 0.75), 4) AS q75, max(value) AS max FROM ({_line_values()}) GROUP BY variable"""
)
def describe_numeric(spark, sf_dir):
    return _rounded(
        profile.describe(b.table(spark, sf_dir, "lineitem"), _LINE), dict.fromkeys(["mean", "std", "q25", "q50", "q75"], 4)
    )


@query(
    b.HOLES_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS columna, count(*) - count({c}) AS faltantes FROM holes"
        for c in ["c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"]
    )
)
def missing_by_column(spark, sf_dir):
    return profile.missing_by_column(b.customers_with_holes(spark, sf_dir))


@query(
    b.HOLES_SQL
    + " UNION ALL ".join(
        f"SELECT {i} AS posicion, '{c}' AS columna, '{t}' AS tipo, count({c}) AS no_nulos, count(*) AS filas FROM holes"
        for i, (c, t) in enumerate(
            [("c_custkey", "bigint"), ("c_acctbal", "double"), ("c_nationkey", "int"), ("c_mktsegment", "string")]
        )
    )
)
def frame_info(spark, sf_dir):
    return profile.frame_info(b.customers_with_holes(spark, sf_dir))


def _box_sql(source: str, group: str) -> str:
    return f"""q AS (SELECT {group}, count(value) AS n, quantile_cont(value, 0.25) AS q25,
    quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM {source} GROUP BY {group}),
  f AS (SELECT *, q25 - 1.5::DOUBLE * (q75 - q25) AS cerca_inf, q75 + 1.5::DOUBLE * (q75 - q25) AS cerca_sup FROM q)
  SELECT {group}, n, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
    round(cerca_inf, 6) AS cerca_inf, round(cerca_sup, 6) AS cerca_sup,
    min(value) FILTER (WHERE value BETWEEN cerca_inf AND cerca_sup) AS bigote_inf,
    max(value) FILTER (WHERE value BETWEEN cerca_inf AND cerca_sup) AS bigote_sup,
    count(*) FILTER (WHERE value NOT BETWEEN cerca_inf AND cerca_sup) AS atipicos
  FROM {source} JOIN f USING ({group}) GROUP BY ALL"""


# prices have two decimals, so fences have at most five: six digits cannot tie
_BOX_ROUND = dict.fromkeys(["q25", "q50", "q75", "cerca_inf", "cerca_sup"], 6)


@query(
    b.STAR_SQL
    + """, edades AS (SELECT descripcion_sexo, CAST(edad AS DOUBLE) AS value FROM dim_cliente JOIN dim_sexo USING (id_sexo)), """
    + _box_sql("edades", "descripcion_sexo")
)
def box_age_by_sex(spark, sf_dir):
    boxes = profile.box_statistics(star_ops.age_by_sex(b.star(spark, sf_dir)), "edad", ["descripcion_sexo"])
    return _rounded(boxes, _BOX_ROUND)


@query(
    b.STAR_SQL
    + """, limites AS (SELECT target, CAST(limite_credito AS DOUBLE) AS value FROM vw_ml_dataset), """
    + _box_sql("limites", "target")
)
def box_limit_by_target(spark, sf_dir):
    boxes = profile.box_statistics(
        b.stored_dataset(spark, sf_dir, "target", "limite_credito"), "limite_credito", ["target"]
    )
    return _rounded(boxes, _BOX_ROUND)


@query(f"WITH filas AS ({_line_values()}), " + _box_sql("filas", "variable"))
def box_per_column(spark, sf_dir):
    return _rounded(profile.box_statistics_wide(b.table(spark, sf_dir, "lineitem"), _LINE), _BOX_ROUND)


@query(
    """WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50.0::DOUBLE AS w FROM orders),
  c AS (SELECT least(CAST(floor((o_totalprice - lo) / w) AS INTEGER), 49) AS bin, count(*) AS n FROM orders, s GROUP BY 1)
  SELECT CAST(b AS INTEGER) AS bin, round(lo + b * w, 4) AS desde, coalesce(n, 0) AS n
  FROM range(50) r(b) CROSS JOIN s LEFT JOIN c ON c.bin = b"""
)
def histogram_limit(spark, sf_dir):
    return _rounded(profile.histogram(b.table(spark, sf_dir, "orders"), "o_totalprice", 50), {"desde": 4})


@query(
    """WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 60.0::DOUBLE AS w FROM orders),
  c AS (SELECT o_orderstatus, least(CAST(floor((o_totalprice - lo) / w) AS INTEGER), 59) AS bin, count(*) AS n
        FROM orders, s GROUP BY 1, 2),
  g AS (SELECT DISTINCT o_orderstatus FROM orders)
  SELECT g.o_orderstatus, CAST(b AS INTEGER) AS bin, round(lo + b * w, 4) AS desde, coalesce(n, 0) AS n
  FROM range(60) r(b) CROSS JOIN s CROSS JOIN g LEFT JOIN c ON c.bin = b AND c.o_orderstatus = g.o_orderstatus"""
)
def histogram_by_class(spark, sf_dir):
    return _rounded(
        profile.histogram(b.table(spark, sf_dir, "orders"), "o_totalprice", 60, by="o_orderstatus"), {"desde": 4}
    )


@query(
    """WITH s AS (SELECT count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) AS sd FROM customer),
  t AS (SELECT *, sd * pow(n, -0.2::DOUBLE) AS h, (hi - lo) / 199 AS w FROM s)
  SELECT CAST(b AS INTEGER) AS punto, round(lo + b * w, 6) AS x,
    round(sum(exp(-0.5::DOUBLE * pow((lo + b * w - c_acctbal) / h, 2))) / (n * h * sqrt(2 * pi())), 12) AS densidad
  FROM range(200) r(b), customer, t GROUP BY b, lo, w, n, h"""
)
def kde_grid(spark, sf_dir):
    return _rounded(profile.density(b.table(spark, sf_dir, "customer"), "c_acctbal"), {"x": 6, "densidad": 12})


def _corr_sql(x: str, y: str) -> str:
    return f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM lineitem"


@query(" UNION ALL ".join(_corr_sql(x, y) for x in _LINE for y in _LINE))
def correlation_matrix(spark, sf_dir):
    return _rounded(profile.correlation_matrix(b.table(spark, sf_dir, "lineitem"), _LINE), {"r": 6})


#: all predictors of the ML dataset
_CREDIT = ["limite_credito", "id_sexo", "id_educacion", "id_estado_civil", "edad", *PAY_COLUMNS, *BILL_COLUMNS, *PAID_COLUMNS]


def _target_corr(digits: int = 6) -> str:
    return b.STAR_SQL + ", c AS (" + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, corr(CAST({v} AS DOUBLE), CAST(target AS DOUBLE)) AS r FROM vw_ml_dataset"
        for v in _CREDIT
    ) + ")"


@query(_target_corr() + " SELECT variable, round(r, 6) AS r FROM c")
def target_correlation(spark, sf_dir):
    data = b.stored_dataset(spark, sf_dir, *_CREDIT, "target")
    return _rounded(profile.target_correlation(data, "target", _CREDIT), {"r": 6})


@query(_target_corr() + " SELECT variable, round(abs(r), 6) AS r_abs FROM c ORDER BY abs(r) DESC NULLS LAST, variable LIMIT 10")
def top_correlations(spark, sf_dir):
    data = b.stored_dataset(spark, sf_dir, *_CREDIT, "target")
    return _rounded(profile.top_correlations(data, "target", 10, _CREDIT), {"r_abs": 6})


@query(
    _target_corr()
    + """, t AS (SELECT variable FROM c ORDER BY abs(r) DESC NULLS LAST, variable LIMIT 10),
  v AS (UNPIVOT (SELECT id_cliente, """
    + ", ".join(f'CAST({v} AS DOUBLE) AS "{v}"' for v in _CREDIT)
    + """, CAST(target AS DOUBLE) AS target FROM vw_ml_dataset) ON * EXCLUDE (id_cliente) INTO NAME variable VALUE value),
  k AS (SELECT * FROM v WHERE variable = 'target' OR variable IN (FROM t))
  SELECT a.variable AS x, d.variable AS y, round(corr(a.value, d.value), 6) AS r
  FROM k a JOIN k d USING (id_cliente) GROUP BY a.variable, d.variable"""
)
def correlation_submatrix(spark, sf_dir):
    data = b.stored_dataset(spark, sf_dir, *_CREDIT, "target")
    return _rounded(profile.top_correlation_matrix(data, "target", 10, _CREDIT), {"r": 6})


@query(
    b.SCORES_SQL
    + """SELECT round(avg(probabilidad), 8) AS media, round(stddev_pop(probabilidad), 8) AS desviacion,
  round(median(probabilidad), 8) AS mediana FROM scores"""
)
def probability_stats(spark, sf_dir):
    stats = profile.probability_statistics(b.scored_labels(spark, sf_dir), "probabilidad")
    return _rounded(stats, dict.fromkeys(["media", "desviacion", "mediana"], 8))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey,
  round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) + 0 AS l_quantity,
  round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) + 0 AS l_extendedprice
  FROM lineitem"""
)
def standardize(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice"]
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *columns)
    return features.standardize(rows, columns).withColumns({c: F.round(c, 6) + 0.0 for c in columns})


@query(
    """WITH c AS (SELECT toxic, count(*) AS n_clase FROM labels GROUP BY toxic)
  SELECT toxic, n_clase, round((SELECT sum(n_clase) FROM c) / ((SELECT count(*) FROM c) * n_clase), 8) AS peso FROM c"""
)
def class_weights(spark, sf_dir):
    return _rounded(features.class_weights(b.table(spark, sf_dir, "labels"), "toxic"), {"peso": 8})


@query(
    """SELECT toxic, CAST(floor(count(*) * 0.2::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS prueba,
  count(*) - CAST(floor(count(*) * 0.2::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS entrenamiento FROM labels GROUP BY toxic"""
)
def stratified_split_counts(spark, sf_dir):
    cut = features.slices(b.table(spark, sf_dir, "labels"), "doc_id", "toxic", [0.2])
    return cut.groupBy("toxic").agg(
        F.count_if(F.col("slice") == 0).alias("prueba"), F.count_if(F.col("slice") == 1).alias("entrenamiento")
    )


@query(
    """SELECT o_orderstatus, CAST(floor(count(*) * (1.0::DOUBLE / 3) + 0.5::DOUBLE) AS BIGINT) AS pliegue_0,
  CAST(floor(count(*) * (2.0::DOUBLE / 3) + 0.5::DOUBLE) AS BIGINT)
    - CAST(floor(count(*) * (1.0::DOUBLE / 3) + 0.5::DOUBLE) AS BIGINT) AS pliegue_1,
  count(*) - CAST(floor(count(*) * (2.0::DOUBLE / 3) + 0.5::DOUBLE) AS BIGINT) AS pliegue_2
  FROM orders GROUP BY o_orderstatus"""
)
def stratified_fold_counts(spark, sf_dir):
    rows = features.stratified_folds(b.table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 3)
    return rows.groupBy("o_orderstatus").agg(
        *[F.count_if(F.col("fold") == i).alias(f"pliegue_{i}") for i in range(3)]
    )


@query(
    b.SCORES_SQL
    + """SELECT a AS "real", p AS predicho, (SELECT count(*) FROM scores WHERE "real" = a AND predicho = p) AS n
  FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p)"""
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(b.scored_labels(spark, sf_dir), "real", "predicho")


@query(
    b.SCORES_SQL
    + """SELECT count(*) FILTER (WHERE "real" = 0 AND predicho = 0) AS tn, count(*) FILTER (WHERE "real" = 0 AND predicho = 1) AS fp,
  count(*) FILTER (WHERE "real" = 1 AND predicho = 0) AS fn, count(*) FILTER (WHERE "real" = 1 AND predicho = 1) AS tp,
  count(*) FILTER (WHERE "real" = 1) AS positivos FROM scores"""
)
def detected_of_total(spark, sf_dir):
    return metrics.binary_counts(b.scored_labels(spark, sf_dir), "real", "predicho")


_REPORT_SQL = """, k AS (SELECT c, count(*) FILTER (WHERE "real" = c AND predicho = c) AS hit,
    count(*) FILTER (WHERE predicho = c) AS said, count(*) FILTER (WHERE "real" = c) AS soporte
  FROM scores, (VALUES (0), (1)) l(c) GROUP BY c),
  m AS (SELECT c, soporte, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(soporte, 0), 0) AS r,
    coalesce(2.0::DOUBLE * hit / nullif(said + soporte, 0), 0) AS f FROM k),
  t AS (SELECT avg(CAST("real" = predicho AS INTEGER)) AS acc, count(*) AS n FROM scores)
  SELECT CAST(c AS VARCHAR) AS clase, round(p, 8) AS precision, round(r, 8) AS recall, round(f, 8) AS f1, soporte FROM m
  UNION ALL SELECT 'accuracy', round(acc, 8), round(acc, 8), round(acc, 8), n FROM t
  UNION ALL SELECT 'macro avg', round(avg(p), 8), round(avg(r), 8), round(avg(f), 8), CAST(sum(soporte) AS BIGINT) FROM m
  UNION ALL SELECT 'weighted avg', round(sum(p * soporte) / sum(soporte), 8), round(sum(r * soporte) / sum(soporte), 8),
    round(sum(f * soporte) / sum(soporte), 8), CAST(sum(soporte) AS BIGINT) FROM m"""


@query(b.SCORES_SQL + _REPORT_SQL)
def classification_report(spark, sf_dir):
    report = metrics.classification_report(b.scored_labels(spark, sf_dir), "real", "predicho")
    return _rounded(report, dict.fromkeys(["precision", "recall", "f1"], 8))


_RUNS_SQL = """, c AS (SELECT probabilidad AS umbral, count(*) FILTER (WHERE "real" = 1) AS pos,
    count(*) FILTER (WHERE "real" <> 1) AS neg FROM scores GROUP BY probabilidad),
  r AS (SELECT umbral, pos, neg, sum(pos) OVER (ORDER BY umbral DESC) AS tp, sum(neg) OVER (ORDER BY umbral DESC) AS fp FROM c),
  t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM c)"""


@query(
    b.SCORES_SQL
    + _RUNS_SQL
    + """ SELECT round(umbral, 8) AS umbral, round(fp / n, 8) AS fpr, round(tp / p, 8) AS tpr FROM r, t
  UNION ALL SELECT 2.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"""
)
def roc_curve(spark, sf_dir):
    """The starting point's infinite threshold is shown as 2."""
    points = metrics.roc_curve(b.scored_labels(spark, sf_dir), "real", "probabilidad")
    shown = points.withColumn("umbral", F.when(F.col("umbral") > 1, 2.0).otherwise(F.col("umbral")))
    return _rounded(shown, dict.fromkeys(["umbral", "fpr", "tpr"], 8))


@query(
    b.SCORES_SQL
    + """SELECT round(sum(CASE WHEN a.probabilidad > z.probabilidad THEN 1.0::DOUBLE WHEN a.probabilidad = z.probabilidad
    THEN 0.5::DOUBLE ELSE 0 END) / count(*), 8) AS auc
  FROM scores a, scores z WHERE a."real" = 1 AND z."real" = 0"""
)
def auc(spark, sf_dir):
    """Compared with the share of (positive, negative) pairs in the right order."""
    return _rounded(metrics.roc_auc(b.scored_labels(spark, sf_dir), "real", "probabilidad"), {"auc": 8})


@query(
    b.SCORES_SQL
    + """, k AS (SELECT u, count(*) FILTER (WHERE "real" = 0 AND probabilidad < u) AS tn,
    count(*) FILTER (WHERE "real" = 0 AND probabilidad >= u) AS fp, count(*) FILTER (WHERE "real" = 1 AND probabilidad < u) AS fn,
    count(*) FILTER (WHERE "real" = 1 AND probabilidad >= u) AS tp
    FROM scores, (VALUES (0.35::DOUBLE), (0.5::DOUBLE)) x(u) GROUP BY u)
  SELECT u AS umbral, tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision,
    round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1 FROM k"""
)
def threshold_impact(spark, sf_dir):
    impact = metrics.threshold_impact(b.scored_labels(spark, sf_dir), "real", "probabilidad", [0.35, 0.5])
    return _rounded(impact, dict.fromkeys(["recall", "precision", "f1"], 8))


@query(
    b.HOLES_SQL
    + """SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM holes)), 6) AS c_acctbal,
  round(coalesce(CAST(c_nationkey AS DOUBLE), (SELECT avg(c_nationkey) FROM holes)), 6) AS c_nationkey FROM holes"""
)
def impute_means_batch(spark, sf_dir):
    filled = features.fill_with_means(b.customers_with_holes(spark, sf_dir), ["c_acctbal", "c_nationkey"])
    return _rounded(filled.drop("c_mktsegment"), {"c_acctbal": 6, "c_nationkey": 6})


_CENTRES_SQL = """WITH cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) AS i FROM embeddings),
  centres AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY label, i),
  gaps AS (SELECT vec_id, c.label, sum((x - m) * (x - m)) AS d FROM cells JOIN centres c USING (i) GROUP BY vec_id, c.label),
  best AS (SELECT vec_id, arg_min(label, d) AS cluster, min(d) AS d FROM gaps GROUP BY vec_id)"""


def _nearest(spark, sf_dir):
    rows = b.table(spark, sf_dir, "embeddings")
    return clustering.nearest_centre(rows, "embedding", clustering.mean_centres(rows, "label", "embedding"), "label")


@query(_CENTRES_SQL + " SELECT vec_id, cluster, round(d, 6) AS distancia2 FROM best")
def nearest_centroid(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", "cluster", F.round("distancia2", 6).alias("distancia2"))


def _clustered(spark, sf_dir):
    """Cluster of each vector and a two-class target from its id."""
    return _nearest(spark, sf_dir).select(
        "vec_id", "cluster", ((F.col("vec_id") * 7 + F.col("label")) % 3 == 0).cast("int").alias("target")
    )


_TARGETS_SQL = _CENTRES_SQL + """, filas AS (SELECT vec_id, cluster, CAST((vec_id * 7 + e.label) % 3 = 0 AS INTEGER) AS target
    FROM best JOIN embeddings e USING (vec_id)),
  mayor AS (SELECT cluster, CASE WHEN count(*) FILTER (WHERE target = 1) > count(*) FILTER (WHERE target = 0) THEN 1 ELSE 0 END
    AS clase FROM filas GROUP BY cluster)"""


@query(_TARGETS_SQL + " SELECT cluster, clase AS majority FROM mayor")
def majority_class_by_cluster(spark, sf_dir):
    return reshape.majority_class(_clustered(spark, sf_dir), "cluster", "target")


@query(
    _TARGETS_SQL
    + """, scores AS (SELECT target AS "real", clase AS predicho FROM filas JOIN mayor USING (cluster))"""
    + _REPORT_SQL
)
def cluster_as_classifier(spark, sf_dir):
    predicted = clustering.predict_by_majority(_clustered(spark, sf_dir), "cluster", "target")
    report = metrics.classification_report(predicted, "target", "prediccion")
    return _rounded(report, dict.fromkeys(["precision", "recall", "f1"], 8))


_SKETCHED = ["l_quantity", "l_extendedprice", "l_discount"]
_QUARTERS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@query(" UNION ALL ".join(f"SELECT '{c}' AS columna, count({c}) AS filas, CAST(0 AS BIGINT) AS fuera_de_margen FROM lineitem" for c in _SKETCHED))
def stored_quantiles(spark, sf_dir):
    """Quantiles from sketches kept for four batches: answers whose exact rank is off by more than the stated error."""
    lines, path = b.table(spark, sf_dir, "lineitem"), scratch_path(spark, "sketches")
    for batch in range(4):
        part = lines.where(F.col("l_orderkey") % 4 == batch)
        sketches.append_sketches(sketches.column_sketches(part, _SKETCHED), path, batch)
    merged = sketches.merged(sketches.read_sketches(spark, path))
    found = sketches.quantiles(merged, _QUARTERS).collect()  # a row for each column and probability
    total, error = {r["columna"]: r["filas"] for r in found}, sketches.rank_error()
    ranks = lines.agg(
        *[F.count_if(F.col(r["columna"]) < F.lit(r["valor"])).alias(f"b{i}") for i, r in enumerate(found)],
        *[F.count_if(F.col(r["columna"]) <= F.lit(r["valor"])).alias(f"u{i}") for i, r in enumerate(found)],
    ).first()
    beyond = dict.fromkeys(_SKETCHED, 0)
    for i, r in enumerate(found):
        low, high = ranks[f"b{i}"] / total[r["columna"]], ranks[f"u{i}"] / total[r["columna"]]
        beyond[r["columna"]] += not low - error <= r["p"] <= high + error
    return spark.createDataFrame([(c, total[c], beyond[c]) for c in _SKETCHED], "columna string, filas long, fuera_de_margen long")
