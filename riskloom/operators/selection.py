"""Exact rank selection and running totals that never sort a table in one task.

Quantiles, "first n by id", hold-out splits and ROC curves all need the row (or
the running sum) at a global rank. A window without partitions would push every
row through one task, and so would a per-group window when one group is hot.
Here a mergeable sketch only chooses where to look; counting decides.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.filters import nan_as_null
from riskloom.operators.reshape import to_variables
from riskloom.sizing import join_checked, keep_local

SKETCH_ACCURACY = 50_000
WINDOW_ROWS = 1_000_000
#: Parts into which a refined interval is cut, and copies of a row that one task makes.
REFINED_PARTS, COPIES_AT_ONCE = 64, 100_000


def order_statistics(
    df: DataFrame,
    value: str,
    targets: Mapping[str, tuple[float, Column]],
    by: Sequence[str] = (),
    accuracy: int = SKETCH_ACCURACY,
    group_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """The values found at given ranks, exactly, per group.

    ``targets`` maps an output name to ``(fraction, rank)``: ``rank`` is a
    0-based rank written over the column ``n`` (rows in the group), ``fraction``
    its rough place in [0, 1]. NULL and NaN values and NULL groups are left out.

    Rows are counted per value first (map-side combined). While no group has
    more than ``group_rows`` rows, one running count per group finds the ranks.
    Larger groups take three passes:

    1. A mergeable sketch gives two cut points around each target.
    2. Rows between cut points are counted.
    3. Only the intervals that hold a target are counted value by value, and
       the running count inside an interval (about ``4 / accuracy`` of the
       group) finds the value. A poor sketch makes an interval longer, never
       the answer wrong.
    """
    by = list(by)
    present = df.select(*by, F.col(value).alias("__v")).where(_present(df, value))
    for column in by:
        present = present.where(F.col(column).isNotNull())
    sizes, local = keep_local(present.groupBy(*by).agg(F.count("*").alias("n")))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= group_rows:
        return _ranks_by_window(present, targets, by, F.broadcast(sizes) if local else sizes, largest)
    return _ranks_by_sketch(present, targets, by, accuracy, group_rows)


def _ranks_by_window(
    values: DataFrame, targets: Mapping[str, tuple[float, Column]], by: list[str], sizes: DataFrame, largest: int
) -> DataFrame:
    run = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counts = values.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    sized = counts.join(sizes, by) if by else counts.withColumn("n", F.lit(largest))
    runs = sized.withColumn("__upto", F.sum("__c").over(run))
    since = F.col("__upto") - F.col("__c")
    found = [
        F.max(F.when((rank.cast("long") >= since) & (rank.cast("long") < F.col("__upto")), F.col("__v"))).alias(name)
        for name, (_, rank) in targets.items()
    ]
    return runs.groupBy(*by).agg(F.max("n").alias("n"), *found)


def _ranks_by_sketch(
    values: DataFrame, targets: Mapping[str, tuple[float, Column]], by: list[str], accuracy: int, group_rows: int
) -> DataFrame:
    margin = 2.0 / accuracy
    probes = sorted(
        {min(max(fraction + d, 0.0), 1.0) for fraction, _ in targets.values() for d in (-margin, margin)}
    )
    sketch = values.groupBy(*by).agg(F.percentile_approx("__v", probes, accuracy).alias("__cuts"))
    if by:
        cuts, local = keep_local(sketch)
        placed = values.join(F.broadcast(cuts) if local else cuts, by)
    else:
        found = sketch.first()["__cuts"] or []
        kind = values.schema["__v"].dataType
        placed = values.withColumn("__cuts", F.array(*[F.lit(c).cast(kind) for c in found]))
        probes = probes[: len(found)]
    slot = reduce(lambda a, b: a + b, [(F.col("__v") > F.col("__cuts")[i]).cast("int") for i in range(len(probes))], F.lit(0))
    placed = placed.select(*by, "__v", slot.alias("__slot"))

    group = Window.partitionBy(*by)
    intervals = (
        placed.groupBy(*by, "__slot")
        .agg(F.count("*").alias("__c"))
        .withColumn("n", F.sum("__c").over(group))
        .withColumn("__start", F.sum("__c").over(group.orderBy("__slot")) - F.col("__c"))
    )
    wanted = (
        intervals.withColumn(
            "__t",
            F.explode(
                F.array(*[F.struct(F.lit(k).alias("__name"), r.cast("long").alias("__rank")) for k, (_, r) in targets.items()])
            ),
        )
        .select(*by, "__slot", "__start", "__c", "n", "__t.__name", "__t.__rank")
        .where("__rank >= __start and __rank < __start + __c")
    )
    wanted, local = keep_local(wanted)
    hint = F.broadcast if local else (lambda frame: frame)
    largest = wanted.agg(F.max("__c")).first()[0] or 0
    if largest > group_rows:
        inner = [*by, "__slot"]
        inside = placed.join(hint(wanted.select(*inner).distinct()), inner)
        asked = wanted.select(*inner, "n", "__name", (F.col("__rank") - F.col("__start")).alias("__rank"))
        hits = _refined(inside, asked, inner, group_rows, largest)
        return hits.groupBy(*by).agg(
            F.max("n").alias("n"), *[F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in targets]
        )
    wanted = wanted.drop("__c")
    inside = Window.partitionBy(*by, "__slot").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        placed.join(hint(wanted.select(*by, "__slot", "__start").distinct()), [*by, "__slot"])
        .groupBy(*by, "__slot", "__start", "__v")
        .agg(F.count("*").alias("__c"))
        .withColumn("__upto", F.col("__start") + F.sum("__c").over(inside))
        .select(*by, "__slot", "__v", (F.col("__upto") - F.col("__c")).alias("__since"), "__upto")
    )
    hits = runs.join(hint(wanted), [*by, "__slot"]).where("__rank >= __since and __rank < __upto")
    return hits.groupBy(*by).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in targets]
    )


def _refined(values: DataFrame, asked: DataFrame, by: list[str], group_rows: int, largest: int) -> DataFrame:
    """``asked`` rows (``by``, n, __name, __rank) with the value ``__v`` at their rank in their group.

    Each group is cut into parts by its own sketch and counted; the parts that
    hold a rank are the groups of the next round, until the largest fits a
    window or no cut makes it smaller (then it is one value over and over, and
    counting leaves one row of it).
    """
    grid = [i / REFINED_PARTS for i in range(1, REFINED_PARTS)]
    cuts = values.groupBy(*by).agg(F.percentile_approx("__v", grid, SKETCH_ACCURACY).alias("__cuts"))
    part = f"__part{len(by)}"
    placed = join_checked(values, cuts, by).withColumn(
        part, F.size(F.filter("__cuts", lambda c: F.col("__v") > c))
    ).drop("__cuts")
    group = Window.partitionBy(*by)
    counted = placed.groupBy(*by, part).agg(F.count("*").alias("__c"))
    counted = counted.withColumn("__start", F.sum("__c").over(group.orderBy(part)) - F.col("__c"))
    found = asked.join(counted, by).where("__rank >= __start and __rank < __start + __c")
    found, _ = keep_local(found)
    inner = [*by, part]
    size = found.agg(F.max("__c")).first()[0] or 0
    inside = join_checked(placed, found.select(*inner).distinct(), inner)
    asked = found.select(*inner, "n", "__name", (F.col("__rank") - F.col("__start")).alias("__rank"))
    if group_rows < size < largest:
        return _refined(inside, asked, inner, group_rows, size)
    run = Window.partitionBy(*inner).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    runs = inside.groupBy(*inner, "__v").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(run))
    return asked.join(runs, inner).where("__rank >= __upto - __n and __rank < __upto")


def _present(df: DataFrame, value: str) -> Column:
    ok = F.col(value).isNotNull()
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        ok = ok & ~F.isnan(value)
    return ok


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    group_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Quantiles by linear interpolation between order statistics, per group, with its size ``n``."""
    by = list(by)
    names = list(names or [f"q{round(p * 100)}" for p in probabilities])
    numbers = df.select(*by, F.col(value).cast("double").alias(value))
    position = {p: (F.col("n") - 1) * F.lit(float(p)) for p in probabilities}
    targets: dict[str, tuple[float, Column]] = {}
    for name, p in zip(names, probabilities):
        targets[f"{name}__lo"] = (p, F.floor(position[p]))
        targets[f"{name}__hi"] = (p, F.ceil(position[p]))
    found = order_statistics(numbers, value, targets, by, group_rows=group_rows)
    out = [
        (F.col(f"{name}__lo") + (F.col(f"{name}__hi") - F.col(f"{name}__lo")) * (position[p] - F.floor(position[p]))).alias(name)
        for name, p in zip(names, probabilities)
    ]
    return found.select(*by, "n", *out)


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    names: Sequence[str] | None = None,
    group_rows: int = WINDOW_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """(variable, n, quantiles) of each column as :func:`exact_quantiles` gives them; columns without values have no row.

    Small tables become rows of (variable, value). Larger ones stay wide: one aggregate sketches all columns, one
    counts the values below and at every cut, and only values strictly between two cuts that hold a rank (about
    ``4 / accuracy`` of a column) become rows. A rank among the values equal to a cut needs none.
    """
    names = list(names or [f"q{round(p * 100)}" for p in probabilities])
    numbers = nan_as_null(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))

    def by_rows() -> DataFrame:
        return exact_quantiles(to_variables(numbers, columns), "value", probabilities, ["variable"], names, group_rows)

    def probes(n: int) -> list[float]:
        margin = 2.0 / min(accuracy, max(n, 1))  # two rows at least
        return sorted({min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-margin, margin)})

    sizes = numbers.agg(*[F.count(c).alias(c) for c in columns]).first()
    if max(sizes[c] for c in columns) <= group_rows:
        return by_rows()
    sketch = numbers.agg(*[F.percentile_approx(c, probes(sizes[c]), accuracy).alias(c) for c in columns]).first()
    cuts = {c: sorted(set(sketch[c] or [])) for c in columns}
    places = [(c, k) for c in columns for k in range(len(cuts[c]))]
    below = [F.count_if(F.col(c) < F.lit(cuts[c][k])).alias(f"b{i}") for i, (c, k) in enumerate(places)]
    upto = [F.count_if(F.col(c) <= F.lit(cuts[c][k])).alias(f"u{i}") for i, (c, k) in enumerate(places)]
    counted = numbers.agg(*below, *upto).first()
    found: dict[tuple[int, int], float] = {}  # (column, rank) -> value
    between: dict[tuple[int, int], tuple[float | None, float | None, int, int]] = {}  # (column, slot) -> ends, rows before, rows
    asked: list[tuple[int, int, int]] = []  # (column, slot, rank)
    for x, c in enumerate(columns):
        own = [(counted[f"b{i}"], counted[f"u{i}"]) for i, (name, _) in enumerate(places) if name == c]
        spots = [(sizes[c] - 1) * p for p in probabilities] if sizes[c] else []
        for rank in sorted({r for s in spots for r in (math.floor(s), math.ceil(s))}):
            slot = sum(b <= rank for b, _ in own)  # cuts with fewer rows below them than the rank
            if slot and rank < own[slot - 1][1]:
                found[x, rank] = cuts[c][slot - 1]
                continue
            before, after = own[slot - 1][1] if slot else 0, own[slot][0] if slot < len(own) else sizes[c]
            between[x, slot] = (cuts[c][slot - 1] if slot else None, cuts[c][slot] if slot < len(own) else None, before, after - before)
            asked.append((x, slot, rank))
    if any(rows > group_rows for *_, rows in between.values()):
        return by_rows()  # a poor sketch
    if asked:
        cells = []
        for (x, slot), (low, high, _, _) in between.items():
            v = F.col(columns[x])
            inside = v.isNotNull() & (F.lit(True) if low is None else v > low) & (F.lit(True) if high is None else v < high)
            cells.append(F.when(inside, F.struct(F.lit(x).alias("x"), F.lit(slot).alias("slot"), v.alias("v"))))
        values = numbers.select(F.inline(F.filter(F.array(*cells), lambda cell: cell.isNotNull())))
        run = Window.partitionBy("x", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        runs = values.groupBy("x", "slot", "v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(run))
        ranks = [(x, slot, rank, rank - between[x, slot][2]) for x, slot, rank in asked]
        wanted = df.sparkSession.createDataFrame(ranks, "x int, slot int, rank long, place long")
        hits = runs.join(F.broadcast(wanted), ["x", "slot"]).where("place >= upto - c and place < upto")
        found |= {(r["x"], r["rank"]): r["v"] for r in hits.collect()}  # one for each column and rank
    rows = []
    for x, c in enumerate(columns):
        if sizes[c]:
            spots = [(sizes[c] - 1) * float(p) for p in probabilities]
            ends = [(found[x, math.floor(s)], found[x, math.ceil(s)], s - math.floor(s)) for s in spots]
            rows.append((c, sizes[c], *[low + (high - low) * part for low, high, part in ends]))
    kinds = ", ".join(["variable string, n long", *[f"`{n}` double" for n in names]])
    return df.sparkSession.createDataFrame(rows, kinds)


def running_totals(
    df: DataFrame,
    order_by: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    window_rows: int = WINDOW_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``cum_<measure>`` columns: running sums in the order of ``order_by``.

    ``df`` must hold one row per (``by``, ``order_by``), so aggregate first. Up to
    ``window_rows`` rows one window does it. Beyond that the order column is cut
    into ranges at fixed quantiles, each range is summed, and a window inside
    each range starts from the total of the ranges before it. ``rows`` is the
    row count, if the caller knows it.
    """
    by = list(by)
    rows = df.count() if rows is None else rows

    def ordered(col: str) -> Column:
        return F.col(col).desc() if descending else F.col(col).asc()

    if rows <= window_rows:
        run = Window.partitionBy(*by).orderBy(ordered(order_by)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(m).over(run).alias(f"cum_{m}") for m in measures])

    pieces = max(2, -(-rows // max(1, window_rows // 2)))
    spot, piece = f"__order{len(df.columns)}", f"__piece{len(df.columns)}"  # new names in each round
    while spot in df.columns or piece in df.columns:
        spot, piece = spot + "_", piece + "_"
    numbered = df.withColumn(spot, F.col(order_by).cast("double"))
    inner = numbered.approxQuantile(spot, [i / pieces for i in range(1, pieces)], 0.25 / pieces)
    splits = [float("-inf"), *sorted(set(inner)), float("inf")]
    placed = Bucketizer(splits=splits, inputCol=spot, outputCol=piece, handleInvalid="keep").transform(numbered)
    sums = placed.groupBy(*by, piece).agg(*[F.sum(m).alias(m) for m in measures])
    fewer = len(splits) < rows  # else the ranges are no fewer than the rows, and one window must do
    totals = running_totals(sums, piece, measures, by, descending, window_rows if fewer else rows, len(splits))
    offsets = totals.select(*by, piece, *[(F.col(f"cum_{m}") - F.col(m)).alias(f"__before_{m}") for m in measures])
    run = Window.partitionBy(*by, piece).orderBy(ordered(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    return join_checked(placed, offsets, [*by, piece]).select(
        *df.columns, *[(F.col(f"__before_{m}") + F.sum(m).over(run)).alias(f"cum_{m}") for m in measures]
    )


TOP_ON_DRIVER = 10_000


def split_first_n(df: DataFrame, key: str, n: int, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``n`` rows with the smallest ``key`` (ties by the whole row), and the rest.

    Rows with a NULL key belong to the rest. The n-th key is found by counting;
    only rows that tie with it need ranking, identical copies as one row with a
    count. ``total`` is the number of rows with a key, if the caller knows it.
    """
    keyed = df.where(F.col(key).isNotNull())
    total = keyed.count() if total is None else total
    if n >= total:
        return keyed, df.where(F.col(key).isNull())
    if n <= 0:
        return df.where(F.lit(False)), df
    if n <= TOP_ON_DRIVER:
        cut = keyed.select(key).orderBy(key).limit(n).agg(F.max(key)).first()[0]
    else:
        cut = order_statistics(keyed, key, {"cut": (n / total, F.lit(n - 1))}).first()["cut"]
    sizes = keyed.agg(
        F.count_if(F.col(key) < F.lit(cut)).alias("below"), F.count_if(F.col(key) == F.lit(cut)).alias("tied")
    ).first()
    need = n - sizes["below"]
    if need == sizes["tied"]:
        return keyed.where(F.col(key) <= F.lit(cut)), df.where(F.col(key).isNull() | (F.col(key) > F.lit(cut)))

    columns = df.columns
    copies = keyed.where(F.col(key) == F.lit(cut)).groupBy(*columns).agg(F.count("*").alias("__copies"))
    # rows that agree on the hash but differ in content are taken together or ranked by their text
    copies = copies.withColumn("__rank", F.xxhash64(*columns)).withColumn("__text", F.to_json(F.struct(*columns)))
    per_hash = running_totals(
        copies.groupBy("__rank").agg(F.sum("__copies").alias("rows")), "__rank", ["rows"]
    ).select("__rank", (F.col("cum_rows") - F.col("rows")).alias("__start"))
    same_hash = Window.partitionBy("__rank").orderBy("__text").rowsBetween(Window.unboundedPreceding, 0)
    ranked = copies.join(per_hash, "__rank").withColumn(
        "__since", F.col("__start") + F.sum("__copies").over(same_hash) - F.col("__copies")
    )
    taken = F.least(F.col("__copies"), F.greatest(F.lit(0), F.lit(need) - F.col("__since")))
    ranked = ranked.withColumn("__taken", taken)

    def repeat(times: Column) -> DataFrame:
        """Copies of each row, made by as many tasks as there are parts of ``COPIES_AT_ONCE``."""
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / COPIES_AT_ONCE).cast("long")))
        part = ranked.where(times > 0).withColumn("__times", times).withColumn("__part", parts)
        left = F.least(F.lit(COPIES_AT_ONCE).cast("long"), F.col("__times") - F.col("__part") * COPIES_AT_ONCE)
        spread = part.repartition("__part", "__rank") if need > COPIES_AT_ONCE or sizes["tied"] > COPIES_AT_ONCE else part
        return spread.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), left))).select(*columns)

    first = keyed.where(F.col(key) < F.lit(cut)).unionByName(repeat(F.col("__taken")))
    rest = df.where(F.col(key).isNull() | (F.col(key) > F.lit(cut))).unionByName(
        repeat(F.col("__copies") - F.col("__taken"))
    )
    return first, rest


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """``TOP n`` in a named order (per-partition top-n, then a merge of n rows each)."""
    return df.orderBy(*order).limit(n)


def head_and_tail(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first and last ``n`` rows in key order, marked ``first`` / ``last``."""
    first = top_rows(df, [F.col(key).asc()], n).withColumn("place", F.lit("first"))
    last = top_rows(df, [F.col(key).desc()], n).withColumn("place", F.lit("last"))
    return first.unionByName(last)


def count_duplicates(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and repeats (all but the first) in one grouped pass."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__c"))
    return groups.agg(
        F.coalesce(F.sum("__c"), F.lit(0)).alias("total"),
        F.count("*").alias("distintos"),
        F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("duplicados"),
    )


def without_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row of each set of equal rows (or of rows equal in ``subset``)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column."""
    return df.select(column).distinct().orderBy(column)
