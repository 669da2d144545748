"""Mixing sources by temperature, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found by bisection
(in many parts at once, each round one aggregate over the sources): either the mixture's entropy meets a target, or
no source is repeated more often than a limit allows. A source's budget is then filled with whole passes over it and
a part of one more. A pass is a permutation of blocks of documents and of the documents in each block, so that the
part takes whole blocks and only the block at its end is ordered row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import Scratch
from riskloom.sizing import join_checked

#: Documents in a block, about.
BLOCK_ROWS = 10_000
#: Exponents tried in one round, the range searched, and the width at which the search ends.
PARTS, RANGE, WIDTH = 32, (0.0, 8.0), 1e-12


@dataclass(frozen=True)
class Mixture:
    """The exponent, and per source: tokens, rows, weight, target, passes (whole) and rest (tokens of one more)."""

    exponent: float
    sources: DataFrame


def words(text: Column) -> Column:
    """Tokens of a text, as white-space separated words; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))), F.lit(0)).cast("long")


def _source(name: str) -> Column:
    """Sources as keys that are never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Per exponent: the sum of powered shares, and the entropy of the normalised ones."""
    power = [F.exp(F.lit(a) * F.col("log_share")) for a in exponents]
    row = shares.agg(
        *(F.sum(p).alias(f"z{i}") for i, p in enumerate(power)),
        *(F.sum(p * F.col("log_share")).alias(f"l{i}") for i, p in enumerate(power)),
    ).first()
    return [(row[f"z{i}"], math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"]) for i, a in enumerate(exponents)]


def find_exponent(
    shares: DataFrame, entropy: float | None = None, repetition: float | None = None, passes: float = 1.0
) -> float:
    """The exponent for ``shares`` (log_share of each source with tokens).

    ``entropy``: the target as a part of the largest possible (0 to 1); the mixture comes as close as exponents
    in ``RANGE`` allow. ``repetition``: the flattest mixture in which no source is read more than so many times
    when the budget is ``passes`` times all tokens; if even 1 (the shares as they are) exceeds it, 1 is returned.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either a target entropy or a repetition limit")
    known = shares.agg(F.count(F.lit(1)).alias("n"), F.min("log_share").alias("least")).first()
    if known["n"] < 2:
        return 1.0

    def flat_enough(a: float, z: float, h: float) -> bool:
        if entropy is not None:
            return h >= entropy * math.log(known["n"])
        return passes * math.exp((a - 1) * known["least"]) / z > repetition

    # flat_enough holds below the wanted exponent and fails above it
    low, high = RANGE if entropy is not None else (0.0, 1.0)
    while high - low > WIDTH:
        tried = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        held = [flat_enough(a, *s) for a, s in zip(tried, _sums(shares, tried), strict=True)]
        if not held[0]:
            return low
        if all(held):
            return high
        last = held.index(False)
        low, high = tried[last - 1], tried[last]
    return high


def mixture(
    tokens: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = None
) -> Mixture:
    """Weights for ``tokens`` (source, n_tokens); the budget is all tokens unless given."""
    sources = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    if not total:
        return Mixture(1.0, sources.selectExpr("*", "0D as weight", "0D as target", "0L as passes", "0D as rest"))
    budget = total if budget is None else budget
    shares = sources.where("tokens > 0").select(F.log(F.col("tokens") / F.lit(float(total))).alias("log_share"))
    exponent = find_exponent(shares, entropy, repetition, budget / total)
    ((z, _),) = _sums(shares, [exponent])
    power = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(total)))) / F.lit(z)
    weighted = sources.withColumn("weight", F.when(F.col("tokens") > 0, power).otherwise(0.0))
    weighted = weighted.withColumn("target", F.col("weight") * F.lit(float(budget)))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(0)
    return Mixture(
        exponent,
        weighted.withColumn("passes", passes.cast("long")).withColumn(
            "rest", F.col("target") - F.col("passes") * F.col("tokens")
        ),
    )


def mix(
    docs: DataFrame,
    budget: int | None = None,
    entropy: float | None = None,
    repetition: float | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The mixed corpus, one row per document and pass: ``id_col``, ``source_col``, n_tokens, epoch, block, place, weight.

    Sorted by (source, epoch, block_key, place_key), a source's rows are its permutations. Every source gets its
    target tokens to within one document, never more. A null source is a source of its own. Documents without
    tokens (null or blank text) come in whole passes and where a part passes their place. A row that repeats
    counts as often as it is there; a null id is an id like any other. An empty table, or one without tokens,
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = scratch.keep(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("name"),
            _source(source_col).alias("source"),
            words(F.col(text_col)).alias("n_tokens"),
        ),
        "tokens",
    )
    plan = mixture(narrow, budget, entropy, repetition)
    sources = scratch.keep(plan.sources.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS)), "sources")
    # the pass in which a document stands decides its places
    planned = join_checked(narrow, sources.select("source", "weight", "passes", "rest", "blocks"), ["source"])
    planned = planned.withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "source", F.col("id").cast("string")), F.col("blocks"))
    )

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "block_key": F.xxhash64(F.lit(seed), "source", "epoch", "block"),
                "place_key": F.xxhash64(F.lit(seed), "epoch", F.col("id").cast("string")),
            }
        )

    whole = placed(
        planned.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    )
    part = placed(planned.where("rest > 0").withColumn("epoch", F.col("passes")))
    by_block = Window.partitionBy("source").orderBy("block_key", "block")
    before = F.sum("block_tokens").over(by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = scratch.keep(
        part.groupBy("source", "block", "block_key", "rest")
        .agg(F.sum("n_tokens").alias("block_tokens"))
        .withColumn("start", before - F.col("block_tokens"))
        .where("start <= rest")
        .withColumn("inside", F.col("start") + F.col("block_tokens") <= F.col("rest"))
        .select("source", "block", "start", "inside"),
        "blocks",
    )
    part = join_checked(part, blocks, ["source", "block"])
    by_place = Window.partitionBy("source", "block").orderBy("place_key", "id", "n_tokens")
    sums = F.sum("n_tokens").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = part.where("not inside").withColumn("upto", F.col("start") + sums).where("upto <= rest")
    columns = [
        F.col("id").alias(id_col), F.col("name").alias(source_col), "n_tokens", "epoch", "block", "block_key", "place_key", "weight",
    ]
    return whole.select(*columns).union(part.where("inside").select(*columns)).union(cut.select(*columns))
