"""Positions of the elements of a linked list that is spread over a table.

A round deals the elements to ranges of their numbers, follows the links inside each range and leaves one element for
each piece of list, whose link jumps over the piece. If neighbours in the list mostly have near numbers, a round leaves
few elements. If it leaves more than half of them, a round of random mates follows: an element that drew 1 swallows a
successor that drew 0, which removes a quarter on average whatever the numbers are. When one element is left, the
rounds are unrolled: an element's position is that of its piece plus its distance from the piece's head.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import Scratch

#: Elements of a range: at most about ``RANGE_MOST``; no more ranges than shuffle partitions as long as that holds, and
#: no further cut below ``RANGE_LEAST``.
RANGE_LEAST, RANGE_MOST = 1 << 13, 1 << 19


def walk(arc: np.ndarray, following: np.ndarray, last: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, ...]:
    """(head, offset) of each element among these, and (tail's place, steps to leave) of each head's piece.

    ``last`` marks elements without a successor. ``arc`` must be in ascending order.
    """
    place = np.searchsorted(arc, following)
    inside = (place < len(arc)) & ~last
    inside[inside] = arc[place[inside]] == following[inside]
    head, offset = np.arange(len(arc)), np.zeros(len(arc), np.int64)
    head[place[inside]] = np.flatnonzero(inside)
    offset[place[inside]] = steps[inside]
    while True:
        further = head[head]
        if (further == head).all():
            break
        offset, head = offset + offset[head], further
    tail = np.flatnonzero(~inside)
    return head, offset, tail, offset[tail] + steps[tail]


def _follow(level: DataFrame) -> DataFrame:
    """(arc, head, offset, next, steps): next and steps of a piece stand with its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([])])
        if not table.num_rows:
            return
        table = table.sort_by("arc")
        arc, steps = table.column("arc").to_numpy(), table.column("steps").to_numpy()
        following = table.column("next").combine_chunks()
        last = np.asarray(following.is_null())
        head, offset, tail, leaving = walk(arc, following.fill_null(0).to_numpy(), last, steps)
        place, total = np.full(len(arc), -1), np.zeros(len(arc), np.int64)
        place[head[tail]], total[head[tail]] = tail, leaving
        out = following.take(pa.array(place, mask=place < 0))
        columns = [pa.array(arc), pa.array(arc[head]), pa.array(offset), out, pa.array(total)]
        yield from pa.Table.from_arrays(columns, names=["arc", "head", "offset", "next", "steps"]).to_batches(1 << 16)

    return level.mapInArrow(run, "arc long, head long, offset long, next long, steps long")


def _mates(level: DataFrame, turn: int) -> DataFrame:
    """The same columns as :func:`_follow` gives; elements that no one swallows are their own head."""

    def drew(column: str) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(turn)), F.lit(2))

    mate = level.where(drew("arc") == 0).select(
        F.col("arc").alias("mate"), F.col("next").alias("beyond"), F.col("steps").alias("more")
    )
    both = level.where((drew("arc") == 1) & (drew("next") == 0)).join(mate, F.col("next") == F.col("mate"))
    swallowed = both.select(
        F.col("mate").alias("arc"), F.col("arc").alias("head"), F.col("steps").alias("offset"),
        F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("steps"),
    )
    longer = both.select("arc", F.col("arc").alias("head"), F.lit(0).cast("long").alias("offset"), "beyond", (F.col("steps") + F.col("more")).alias("steps"))
    touched = both.select(F.explode(F.array("arc", "mate")).alias("arc"))
    rest = level.join(touched, "arc", "left_anti").select("arc", F.col("arc").alias("head"), F.lit(0).cast("long").alias("offset"), "next", "steps")
    return swallowed.union(longer).union(rest)


def positions(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(arc, pos) for a list given as (arc, next); next is null at its end. The first element has position 0."""
    partitions = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = scratch.keep(links.select("arc", "next", F.lit(1).cast("long").alias("steps")), f"{name}-links")
    count, inner, mates = level.count(), [], False
    while count > 1:
        ranges = min(math.ceil(count / RANGE_LEAST), max(partitions, math.ceil(count / RANGE_MOST)))
        if mates:
            found = _mates(level, len(inner))
        else:
            found = _follow(level.coalesce(1) if ranges == 1 else level.repartitionByRange(ranges, "arc"))
        found = scratch.keep(found, f"{name}-{len(inner)}")
        inner.append(found.where("arc <> head").select("arc", "head", "offset"))
        level = found.where("arc = head").select("arc", "next", "steps")
        before, count = count, level.count()
        mates = not mates and count > before / 2
    found = level.select("arc", F.lit(0).cast("long").alias("pos"))
    for turn, pieces in reversed(list(enumerate(inner))):
        heads = found.select(F.col("arc").alias("head"), "pos")
        below = pieces.join(heads, "head").select("arc", (F.col("pos") + F.col("offset")).alias("pos"))
        found = scratch.keep(found.union(below), f"{name}-positions-{turn}")
    return found
