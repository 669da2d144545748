"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a vector of its words weighted by their number S. For each of ``SAMPLES`` positions k, a word draws
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from hashes of the word and k alone, and takes part with

    t = floor(ln S / r + b),    a = c * exp(r * (b - t - 1)).

The word with the smallest a is the sample. S enters through t only, so two texts have the same smallest a exactly if
they sampled the same word at the same t, and this happens with the generalised Jaccard similarity of their vectors
(sum of smaller weights over sum of larger weights). The fingerprint keeps 32 bits of each smallest a, and the likeness
of two fingerprints is their share of equal positions.

Each text is shuffled once. Texts are dealt to ranges of their order, and the first document of each range visits the
range before it as a guest, so that what needs the next document (its text for the edited text, its fingerprint for
the likeness) is a neighbour's row. Words are counted inside their row; exploded words are reduced to minima at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import Scratch

#: Samples of a fingerprint, computed in blocks of columns so that the generated code stays small.
SAMPLES, WIDTH = 40, 8
#: Ranges of documents for each shuffle partition, and the documents in a range from which there are more ranges.
RANGES_EACH, RANGE_ROWS = 4, 20_000

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside ``body`` use it for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def weighted_terms(text: Column) -> Column:
    """array<struct<term: long, count: int>> of the words: each distinct word's hash with its number."""
    words = F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))

    def starts(all_: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(all_) - 1)
        first = F.filter(places, lambda i: (i == 0) | (F.get(all_, i) != F.get(all_, i - 1)))
        return F.when(F.size(all_) > 0, first).otherwise(F.array().cast("array<int>"))

    def counted(all_: Column, runs: Column) -> Column:
        def run(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(runs, j + 1), F.size(all_))
            return F.struct(F.get(all_, start).alias("term"), (end - start).alias("count"))

        return F.transform(runs, run)

    return _with(hashes, lambda all_: _with(starts(all_), lambda runs: counted(all_, runs)))


def sampled(k: Column) -> Column:
    """a of the columns ``term`` and ``ln_count`` (ln S) at position ``k``; one hash gives its five uniform numbers."""
    bits = F.xxhash64("term", k)

    def uniform(start: int, size: int) -> Column:
        return (F.shiftrightunsigned(bits, start).bitwiseAND(F.lit((1 << size) - 1)) + 0.5) * 2.0**-size

    r = -F.log(uniform(0, 13) * uniform(13, 13))
    c = -F.log(uniform(26, 13) * uniform(39, 13))
    b = uniform(52, 12)
    t = F.floor(F.col("ln_count") / r + b)
    return c * F.exp(r * (b - t - 1))


def minima(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``block`` and the minima ``m0`` ... of a over each key's ``terms``; null without terms."""
    words = rows.select(*keys, F.explode_outer("terms").alias("word")).select(
        *keys, F.col("word.term").alias("term"), F.log(F.col("word.count").cast("double")).alias("ln_count")
    )
    blocks = words.withColumn("block", F.explode(F.array(*map(F.lit, range(SAMPLES // WIDTH)))))
    least = [F.min(sampled(F.col("block") * WIDTH + j)).alias(f"m{j}") for j in range(WIDTH)]
    return blocks.groupBy(*keys, "block").agg(*least)


def _sample_bits(value: Column) -> Column:
    return F.xxhash64(value).bitwiseAND(F.lit(0xFFFFFFFF))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal positions of two sample arrays; without samples 1 if both have none, else 0."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    none = F.size(a) + F.size(b)
    return F.when(none == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(equal / F.lit(float(SAMPLES)))


def as_text(samples: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits for each sample, empty without samples."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _range_of(bounds: list[tuple[int | None, str]], id_col: str, key: str) -> Column:
    """Number of the range that a row is in; range i starts with the i-th of ``bounds``, which are in order.

    Two steps of about the root of their number each: groups of bounds, then the bounds of one group.
    """
    if len(bounds) < 2:
        return F.lit(0)

    def literal(values: list[tuple[int | None, str]]) -> Column:
        return F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(d).alias("key")) for i, d in values))

    own = F.struct(F.col(id_col).cast("long").alias("id"), F.col(key).alias("key"))
    step = math.isqrt(len(bounds))
    group = F.size(F.filter(literal(bounds[step::step]), lambda x: x <= own))
    groups = F.array(*(literal(bounds[i : i + step]) for i in range(0, len(bounds), step)))
    inside = F.size(F.filter(F.get(groups, group), lambda x: x <= own))
    return F.greatest(group * step + inside - 1, F.lit(0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last ``n_chars // 2`` code points replaced by the first as many (or all) of the next
    document; the last document is followed by the first, a lone one by itself. Documents are ordered by id (null
    first), those with one id by the digest of their text. Rows that repeat an id with the same text are one document
    and share its result. Null text is empty. Texts without words have an empty fingerprint, like each other (1) and
    unlike all others (0). An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "weighted-prints")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("key"), text.alias("text"))
    ids = scratch.keep(source.groupBy("id", "key").agg(F.count(F.lit(1)).alias("copies")), "ids")
    found = ids.agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("rows")).first()
    repeated = (found["rows"] or 0) > found["documents"]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(found["documents"] / RANGE_ROWS))
    bounds = [
        (r["low"]["id"], r["low"]["key"])
        for r in ids.select("id", "key")
        .repartitionByRange(RANGES_EACH * partitions, "id", "key")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(F.struct("id", "key")).alias("low"))
        .orderBy("part")
        .collect()  # one row for each range
    ]
    guests = spark.createDataFrame(
        [(i, d, (n - 1) % len(bounds)) for n, (i, d) in enumerate(bounds)], "guest_id long, guest_key string, visits int"
    )
    texts = source.dropDuplicates(["id", "key"]) if repeated else source
    placed = texts.withColumn("part", _range_of(bounds, "id", "key")).join(
        F.broadcast(guests), F.col("id").eqNullSafe(F.col("guest_id")) & (F.col("key") == F.col("guest_key")), "left"
    )
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("visits").alias("part"), F.lit(True).alias("guest"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("visits").isNull(), F.array(own)).otherwise(F.array(own, visit))))
    dealt = placed.select("at.part", "at.guest", "id", "key", "text").repartition(partitions, "part")
    order = Window.partitionBy("part").orderBy("guest", F.col("id").asc_nulls_first(), "key")
    keys = ["part", "guest", "id", "key"]

    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    both = dealt.withColumn("next", F.lead("text").over(order)).select(
        *keys, n.cast("long").alias("n_chars"), "text", F.when(~F.col("guest"), edited).alias("edited")
    )
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))
    each = both.withColumn("one", F.explode(kinds)).select(
        *keys, "n_chars", "one.kind", F.col("one.body").alias("body")
    ).where("body is not null")
    each = each.withColumn("edited_sha256", F.when(F.col("kind") == 1, F.sha2("body", 256)).otherwise(""))
    several = [*keys, "n_chars", "kind", "edited_sha256"]
    least = minima(each.withColumn("terms", weighted_terms(F.col("body"))).drop("body"), several)
    row = F.when(F.col("m0").isNotNull(), F.struct("block", F.array(*(_sample_bits(F.col(f"m{j}")) for j in range(WIDTH))).alias("bits")))
    ordered = F.flatten(F.transform(F.sort_array("rows"), lambda x: x["bits"]))
    prints = least.groupBy(*several).agg(F.collect_list(row).alias("rows")).select(*several, ordered.alias("samples"))

    def of(kind: int, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    paired = prints.groupBy(*keys, "n_chars").agg(
        of(1, "edited_sha256").alias("edited_sha256"), of(0, "samples").alias("samples"), of(1, "samples").alias("edited")
    )
    done = (
        paired.withColumn("next", F.lead("samples").over(order))
        .where("not guest")
        .select(
            F.col("id").alias(id_col),
            "key",
            "n_chars",
            "edited_sha256",
            as_text(F.col("samples")).alias("fingerprint"),
            as_text(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("samples"), F.col("edited")).alias("near_edited"),
            likeness(F.col("samples"), F.col("next")).alias("near_next"),
        )
    )
    if not repeated:
        return done.drop("key")
    done = scratch.keep(done, "documents")  # apart, so that a hot row can be split in the join
    rows = source.select(F.col("id").alias("row_id"), F.col("key").alias("row_key"))
    return rows.join(done, F.col("row_id").eqNullSafe(F.col(id_col)) & (F.col("row_key") == F.col("key"))).drop(
        "row_id", "row_key", "key"
    )
