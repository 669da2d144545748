"""A small, mergeable summary of a set of keys that keeps other rows out of a shuffle.

It holds the range of the keys, which a scan can skip files by, and a bit table in which every key sets a few bits. A
row passes if its key lies in the range and all its bits are set: every row of the set passes, others seldom do, so a
join behind the filter gives the same rows. Filters of parts are merged by the wider range and the union of the bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize

#: Bits for each key and bits that a key sets: about one foreign key in 140 passes. The table has at most ``MOST_BITS``
#: (2 MB, whatever the number of keys): beyond that more foreign rows pass.
BITS_EACH, HASHES, MOST_BITS = 12, 4, 1 << 24


@dataclass(frozen=True)
class KeyFilter:
    """low and high of the keys (None without keys) and one row with the bit table, as an array of 64-bit words."""

    low: int | None
    high: int | None
    bits: int
    words: DataFrame

    def passes(self, key: str) -> Column:
        """Whether the set may hold a row's key; null keys do not pass."""
        if self.low is None:
            return F.lit(False)
        table = self.words.scalar()
        inside = F.col(key).between(F.lit(self.low), F.lit(self.high))
        for place in _places(key, self.bits):
            word = F.get(table, F.shiftright(place, 6).cast("int"))
            inside &= F.expr("0L") != word.bitwiseAND(_bit(place))
        return inside

    def merged(self, other: KeyFilter) -> KeyFilter:
        """The filter of both sets; their tables must have the same size."""
        if self.bits != other.bits:
            raise ValueError("filters with bit tables of different sizes cannot be merged")
        ends = [x for f in (self, other) for x in (f.low, f.high) if x is not None]
        cells = self.words.select(F.posexplode("words")).union(other.words.select(F.posexplode("words")))
        words = cells.groupBy("pos").agg(F.bit_or("col").alias("word"))
        joined = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda c: c["word"]).alias("words"))
        return KeyFilter(min(ends, default=None), max(ends, default=None), self.bits, joined)


def _places(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.expr("1L"), F.pmod(place, F.lit(64)).cast("int"))


def table_size(keys: int) -> int:
    """Bits for about so many keys: a power of two, as filters of near sizes shall be mergeable."""
    return min(MOST_BITS, max(64, 1 << math.ceil(math.log2(max(1, keys * BITS_EACH)))))


def key_filter(rows: DataFrame, key: str, bits: int | None = None) -> KeyFilter:
    """The filter of all non-null keys of ``rows``, from two aggregates."""
    facts = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("keys")).first()
    bits = bits or table_size(facts["keys"])
    set_bits = rows.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(key, bits))).alias("place"))
    words = set_bits.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(_bit(F.col("place"))).alias("word"))
    places = rows.sparkSession.range(bits // 64).withColumnRenamed("id", "at")
    whole = places.join(words, "at", "left").select(F.struct("at", F.coalesce("word", F.expr("0L")).alias("word")).alias("cell"))
    table = whole.agg(F.transform(F.sort_array(F.collect_list("cell")), lambda c: c["word"]).alias("words"))
    return KeyFilter(facts["low"], facts["high"], bits, materialize(table, "filtro"))  # one row, read by each use
