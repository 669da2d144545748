"""Descriptive statistics of whole tables: describe, boxes, histograms, densities, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.filters import nan_as_null, numeric_columns
from riskloom.operators.selection import column_quantiles, exact_quantiles
from riskloom.sizing import join_checked


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max per numeric column, quartiles exact; NaN counts as missing.

    The moments of all columns are one wide aggregate of one row.
    """
    columns = list(columns or numeric_columns(df))
    numbers = nan_as_null(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    kinds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = numbers.agg(*[F.struct(*[f(c).alias(k) for k, f in kinds.items()]).alias(c) for c in columns])
    moments = wide.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"`{c}`")[k].alias(k) for k in kinds]) for c in columns]))
    )
    quartiles = column_quantiles(numbers, columns, [0.25, 0.5, 0.75]).drop("n")
    return join_checked(moments, quartiles, ["variable"], "left").select(
        "variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """NULLs and NaNs per column, one pass for all columns."""
    wide = nan_as_null(df).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "columna", "faltantes")


def frame_info(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of each column, with the row count."""
    fields = df.schema.fields
    wide = nan_as_null(df).agg(
        F.count("*").alias("__filas"), *[F.count(F.col(f.name)).alias(f.name) for f in fields]
    )
    columns = F.array(
        *[
            F.struct(
                F.lit(i).alias("posicion"),
                F.lit(f.name).alias("columna"),
                F.lit(f.dataType.simpleString()).alias("tipo"),
                F.col(f.name).alias("no_nulos"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return wide.select(F.inline(columns), F.col("__filas").alias("filas"))


def box_statistics(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, fences, whiskers and outlier count per group.

    Whiskers are the extreme values inside ``q1 - 1.5 iqr`` and ``q3 + 1.5 iqr``.
    """
    by = list(by)
    numbers = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    reach = F.lit(1.5) * (F.col("q75") - F.col("q25"))
    boxes = exact_quantiles(numbers, "__v", [0.25, 0.5, 0.75], by).select(
        *by, "n", "q25", "q50", "q75",
        (F.col("q25") - reach).alias("cerca_inf"),
        (F.col("q75") + reach).alias("cerca_sup"),
    )
    inside = F.col("__v").between(F.col("cerca_inf"), F.col("cerca_sup"))
    measures = [
        F.min(F.when(inside, F.col("__v"))).alias("bigote_inf"),
        F.max(F.when(inside, F.col("__v"))).alias("bigote_sup"),
        F.count_if(~inside).alias("atipicos"),
    ]
    keep = ["n", "q25", "q50", "q75", "cerca_inf", "cerca_sup"]
    if not by:
        box = boxes.first()
        fenced = numbers.withColumns({c: F.lit(box[c]) for c in keep})
        return fenced.agg(*[F.lit(box[c]).alias(c) for c in keep], *measures)
    return join_checked(numbers, boxes, by).groupBy(*by, *keep).agg(*measures)


def box_statistics_wide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One box per column that has values; the fences of all columns enter one wide aggregate as literals."""
    columns = list(columns)
    numbers = nan_as_null(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    boxes = {}
    for row in column_quantiles(numbers, columns, [0.25, 0.5, 0.75]).collect():  # one for each column
        reach = 1.5 * (row["q75"] - row["q25"])
        boxes[row["variable"]] = {**row.asDict(), "cerca_inf": row["q25"] - reach, "cerca_sup": row["q75"] + reach}
    facts = []
    for c, box in boxes.items():
        inside = F.col(c).between(F.lit(box["cerca_inf"]), F.lit(box["cerca_sup"]))
        held = F.when(inside, F.col(c))
        found = [F.min(held).alias("bigote_inf"), F.max(held).alias("bigote_sup"), F.count_if(~inside).alias("atipicos")]
        facts.append(F.struct(*[F.lit(v).alias(k) for k, v in box.items()], *found))
    kinds = "variable string, n long, q25 double, q50 double, q75 double, cerca_inf double, cerca_sup double"
    if not facts:
        return df.sparkSession.createDataFrame([], f"{kinds}, bigote_inf double, bigote_sup double, atipicos long")
    rows = numbers.agg(F.array(*facts).alias("boxes")).select(F.inline("boxes"))
    return rows.withColumn("n", F.col("n").cast("long"))


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Counts in ``bins`` equal-width bins over the whole range, the last one closed.

    Empty bins are kept with 0. With ``by`` every class has the same bins.
    """
    numbers = df.select(*([by] if by else []), F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    span = numbers.agg(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi")).alias("s")).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    place = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__v") - lo) / F.when(width == 0, 1.0).otherwise(width)), F.lit(bins - 1))
    )
    keys = [by] if by else []
    counts = numbers.withColumn("bin", place.cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    filled = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("__m"))
    return filled.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "__m").select(
        *keys,
        "bin",
        (lo + F.col("bin") * width).alias("desde"),
        F.coalesce(F.try_element_at("__m", F.col("bin")), F.lit(0)).alias("n"),
    )


#: Boxes per bandwidth of a density, and moments kept of each; see :func:`density`.
BOXES, MOMENTS = 8, 14


def density(df: DataFrame, value: str, grid: int = 200) -> DataFrame:
    """Gaussian kernel density on ``grid`` points from minimum to maximum, Scott bandwidth.

    Values are grouped into boxes an eighth of a bandwidth wide, with the
    moments of their offsets from the box centre: one aggregate over the rows.
    A box then adds to a grid point by the Taylor series of the kernel (Hermite
    polynomials times moments). With offsets of a sixteenth of a bandwidth,
    ``MOMENTS`` terms are exact to double precision. Only boxes, not rows, are
    multiplied by grid points; beyond 39 bandwidths the kernel is 0.0.
    """
    reach = 39
    numbers = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    facts = numbers.agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")
    ).first()
    n, lo, hi, sd = facts["n"], facts["lo"], facts["hi"], facts["sd"]
    points = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("punto"))
    if not n or not sd:
        return points.select("punto", F.lit(lo).alias("x"), F.lit(None).cast("double").alias("densidad"))
    band = sd * n ** (-0.2)
    step = (hi - lo) / (grid - 1)
    width = band / BOXES
    offset = F.col("v") - F.lit(lo)
    box = F.floor(offset / F.lit(width))
    delta = (offset - (box + F.lit(0.5)) * F.lit(width)) / F.lit(band)
    powers = [F.lit(1.0)]
    for _ in range(MOMENTS - 1):
        powers.append(powers[-1] * F.col("d"))
    boxes = (
        numbers.select(box.alias("box"), delta.alias("d"))
        .groupBy("box")
        .agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
        .withColumn("centre", (F.col("box") + F.lit(0.5)) * F.lit(width))
    )
    first = F.greatest(F.lit(0), F.ceil((F.col("centre") - F.lit((reach + 1) * band)) / F.lit(step)).cast("int"))
    last = F.least(F.lit(grid - 1), F.floor((F.col("centre") + F.lit((reach + 1) * band)) / F.lit(step)).cast("int"))
    placed = boxes.withColumn("punto", F.explode(F.sequence(first, last)))
    placed = placed.withColumn("z", (F.col("punto") * F.lit(step) - F.col("centre")) / F.lit(band))
    # exp(-(z - d)^2 / 2) = exp(-z^2 / 2) * sum of He_k(z) d^k / k!
    before, hermite, series, factorial = F.lit(0.0), F.lit(1.0), F.col("m0"), 1.0
    for k in range(1, MOMENTS):
        placed = placed.withColumn(f"h{k}", F.col("z") * hermite - F.lit(float(k - 1)) * before)
        before, hermite, factorial = hermite, F.col(f"h{k}"), factorial * k
        series = series + hermite * F.col(f"m{k}") / F.lit(factorial)
    scale = 1.0 / (n * band * (2 * 3.141592653589793) ** 0.5)
    sums = placed.groupBy("punto").agg(F.sum(F.exp(F.lit(-0.5) * F.col("z") * F.col("z")) * series).alias("w"))
    return points.join(F.broadcast(sums), "punto", "left").select(
        "punto",
        (F.lit(lo) + F.col("punto") * F.lit(step)).alias("x"),
        (F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)) * F.lit(scale)).alias("densidad"),
    )


def _correlation(x: str, y: str, holed: frozenset[str]) -> Column:
    """Pearson correlation over rows where both are present; NULL for a constant column.

    Columns without NULLs share one deviation over all pairs.
    """
    a, b = F.col(x), F.col(y)
    spread_a = F.stddev_pop(F.when(b.isNotNull(), a) if y in holed else a)
    spread_b = F.stddev_pop(F.when(a.isNotNull(), b) if x in holed else b)
    return F.try_divide(F.covar_pop(a, b), spread_a * spread_b)


def _holed(numbers: DataFrame) -> frozenset[str]:
    """Columns that hold a NULL."""
    facts = numbers.agg(*[F.max(F.col(c).isNull()).alias(c) for c in numbers.columns]).first()
    return frozenset(c for c in numbers.columns if facts[c])


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x, y, correlation) for each unordered pair, all pairs in one aggregate."""
    columns = list(columns or numeric_columns(df))
    numbers = nan_as_null(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    holed = _holed(numbers)
    wide = numbers.agg(*[_correlation(x, y, holed).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r"))
                    for i, (x, y) in enumerate(pairs)
                ]
            )
        )
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full matrix as (x, y, r) rows; the diagonal is 1, or NULL for a constant column."""
    columns = list(columns or numeric_columns(df))
    upper = correlation_pairs(df, columns)
    both = upper.select(
        F.inline(F.array(F.struct("x", "y", "r"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("r"))))
    )
    numbers = nan_as_null(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    wide = numbers.agg(*[F.var_pop(c).alias(c) for c in columns])
    diagonal = wide.unpivot([], columns, "x", "v").select(
        "x", F.col("x").alias("y"), F.when(F.col("v") > 0, F.lit(1.0)).alias("r")
    )
    return both.unionByName(diagonal)


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of each column with the target, largest first."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    numbers = nan_as_null(df.select(*[F.col(c).cast("double").alias(c) for c in [*columns, target]]))
    holed = _holed(numbers)
    wide = numbers.agg(*[_correlation(c, target, holed).alias(c) for c in columns])
    return wide.unpivot([], columns, "variable", "r").orderBy(F.col("r").desc_nulls_last(), "variable")


def top_correlations(df: DataFrame, target: str, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` columns with the largest absolute correlation with the target."""
    return (
        target_correlation(df, target, columns)
        .select("variable", F.abs("r").alias("r_abs"))
        .orderBy(F.col("r_abs").desc_nulls_last(), "variable")
        .limit(n)
    )


def top_correlation_matrix(df: DataFrame, target: str, n: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """The correlation matrix of the top ``n`` columns and the target."""
    names = [row["variable"] for row in top_correlations(df, target, n, columns).collect()]
    return correlation_matrix(df, [*names, target])


def probability_statistics(df: DataFrame, probability: str) -> DataFrame:
    """Mean, population std and median of predicted probabilities."""
    moments = df.agg(F.avg(probability).alias("media"), F.stddev_pop(probability).alias("desviacion"))
    median = exact_quantiles(df, probability, [0.5], names=["m"]).select("m").scalar()
    return moments.select("media", "desviacion", median.alias("mediana"))
