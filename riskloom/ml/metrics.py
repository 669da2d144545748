"""Evaluation of classifiers as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.selection import WINDOW_ROWS, running_totals

LABELS = (0, 1)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[int] = LABELS) -> DataFrame:
    """(real, predicho, n) for every label pair, absent pairs 0. One aggregate."""
    pairs = [(a, b) for a in labels for b in labels]
    wide = df.agg(
        *[
            F.count_if((F.col(truth) == F.lit(a)) & (F.col(predicted) == F.lit(b))).alias(f"n_{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("real"), F.lit(b).alias("predicho"), F.col(f"n_{i}").alias("n"))
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def binary_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tn, fp, fn, tp, and how many positives were found of how many."""
    t, p = F.col(truth), F.col(predicted)
    counts = df.agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )
    return counts.withColumn("positivos", F.col("tp") + F.col("fn"))


def classification_report(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[int] = LABELS
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means.

    A ratio with denominator 0 is 0. The table is aggregated once to
    ``len(labels)`` × 3 counts; the rest is arithmetic on that row.
    """
    t, p = F.col(truth), F.col(predicted)
    counts = df.agg(
        *[F.count_if((t == c) & (p == c)).alias(f"hit_{c}") for c in labels],
        *[F.count_if(p == c).alias(f"said_{c}") for c in labels],
        *[F.count_if(t == c).alias(f"real_{c}") for c in labels],
        F.count_if(t == p).alias("right"),
        F.count_if(t.isNotNull() & p.isNotNull()).alias("all"),
    )
    for c in labels:
        hit, said, real = F.col(f"hit_{c}"), F.col(f"said_{c}"), F.col(f"real_{c}")
        counts = counts.withColumns(
            {
                f"precision_{c}": _ratio(hit, said),
                f"recall_{c}": _ratio(hit, real),
                f"f1_{c}": _ratio(hit * 2, said + real),
            }
        )
    support = sum((F.col(f"real_{c}") for c in labels), F.lit(0))

    def row(name: str, precision: Column, recall: Column, f1: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("clase"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), n.alias("soporte"),
        )

    def mean(metric: str, weighted: bool) -> Column:
        if weighted:
            return _ratio(sum((F.col(f"{metric}_{c}") * F.col(f"real_{c}") for c in labels), F.lit(0.0)), support)
        return sum((F.col(f"{metric}_{c}") for c in labels), F.lit(0.0)) / F.lit(float(len(labels)))

    accuracy = _ratio(F.col("right"), F.col("all"))
    rows = [
        row(str(c), F.col(f"precision_{c}"), F.col(f"recall_{c}"), F.col(f"f1_{c}"), F.col(f"real_{c}")) for c in labels
    ]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, support))
    rows.append(row("macro avg", mean("precision", False), mean("recall", False), mean("f1", False), support))
    rows.append(row("weighted avg", mean("precision", True), mean("recall", True), mean("f1", True), support))
    return counts.select(F.inline(F.array(*rows)))


def _score_counts(df: DataFrame, truth: str, score: str) -> DataFrame:
    return (
        df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).alias("umbral"))
        .agg(
            F.count_if(F.col(truth) == 1).alias("pos"),
            F.count_if(F.col(truth) != 1).alias("neg"),
        )
    )


def roc_curve(df: DataFrame, truth: str, score: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """ROC points: one per distinct score, from (0, 0) to (1, 1).

    Rows are first counted per distinct score, so ties are one point.
    """
    counts = _score_counts(df, truth, score)
    facts = counts.agg(F.count("*").alias("rows"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    runs = running_totals(counts, "umbral", ["pos", "neg"], descending=True, window_rows=window_rows, rows=facts["rows"])
    points = runs.select(
        F.col("umbral").cast("double").alias("umbral"),
        _ratio(F.col("cum_neg"), F.lit(facts["neg"])).alias("fpr"),
        _ratio(F.col("cum_pos"), F.lit(facts["pos"])).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("umbral"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def roc_auc(df: DataFrame, truth: str, score: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Area under the ROC curve by trapezoids: per score, its negatives × (positives above + half its own)."""
    counts = _score_counts(df, truth, score)
    runs = running_totals(counts, "umbral", ["pos"], descending=True, window_rows=window_rows)
    above = F.col("cum_pos") - F.col("pos")
    area = F.sum(
        F.col("neg").cast("decimal(19,0)") * (above * 2 + F.col("pos")).cast("decimal(19,0)")
    ).cast("double") / F.lit(2.0)
    return runs.agg(
        F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc")
    )


def threshold_impact(df: DataFrame, truth: str, probability: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts, recall, precision and F1 at several cuts, one pass for all."""
    t = F.col(truth)
    parts = []
    for i, cut in enumerate(thresholds):
        said = F.col(probability) >= F.lit(float(cut))
        parts += [
            F.count_if((t == 1) & said).alias(f"tp_{i}"),
            F.count_if((t == 0) & said).alias(f"fp_{i}"),
            F.count_if((t == 1) & ~said).alias(f"fn_{i}"),
            F.count_if((t == 0) & ~said).alias(f"tn_{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(float(cut)).alias("umbral"),
                *[F.col(f"{k}_{i}").alias(k) for k in ("tn", "fp", "fn", "tp")],
                _ratio(F.col(f"tp_{i}"), F.col(f"tp_{i}") + F.col(f"fn_{i}")).alias("recall"),
                _ratio(F.col(f"tp_{i}"), F.col(f"tp_{i}") + F.col(f"fp_{i}")).alias("precision"),
                _ratio(
                    F.col(f"tp_{i}") * 2, F.col(f"tp_{i}") * 2 + F.col(f"fp_{i}") + F.col(f"fn_{i}")
                ).alias("f1"),
            )
            for i, cut in enumerate(thresholds)
        ]
    )
    return df.agg(*parts).select(F.inline(rows))
