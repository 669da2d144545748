"""Connected components of a link table, as alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import Scratch


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every id in ``links`` (u, v); the component is its smallest id.

    Each round points every id and its larger neighbours at the smallest neighbour (large star), then every id's
    smaller neighbours at the smallest (small star). Minima are pre-aggregated, so a hub is never gathered in one
    task. Rounds end when the table stays the same; their number grows with the logarithm of a chain's length.
    Ids without links do not appear.
    """
    edges = scratch.keep(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-0",
    )
    mark, turn = _mark(edges), 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        turn += 1
        # written apart from the edges, so that the join can split a hub
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("v")), f"{name}-least-{turn}")
        least = least.select("u", F.least("u", "v").alias("m"))
        wide = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        small = wide.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(
            small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}"
        )
        scratch.drop(f"{name}-{turn - 1}", f"{name}-least-{turn}")
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    hubs = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(hubs)
