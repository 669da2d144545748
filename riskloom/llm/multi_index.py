"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised with codebooks of their own; a pair of centroids is a cell. A query visits
cells in the order of the summed distances of its halves to the two centroids, by a heap over the sorted distances,
until the visited cells hold a given part of the different vectors. All entries of visited cells are ranked by the
exact distance of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.folds import bounded_sample
from riskloom.session import Scratch

#: The codebooks are fitted on at most so many vectors (those with the smallest hash of their id).
FIT_ROWS = 20_000
#: Centroids of a half, and rounds of k-means.
CENTROIDS, ROUNDS = 128, 12
#: Part of the different vectors that a query's cells hold at least, and their least number.
VISITED, VISITED_LEAST = 0.4, 2_000
#: Entries and queries in a block, and blocks of a first-half centroid that share a copy of its queries.
ENTRY_BLOCK, QUERY_BLOCK, SHARED_BLOCKS = 2_048, 256, 16


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the halves, and the number of different vectors in each cell."""

    first: np.ndarray
    second: np.ndarray
    different: np.ndarray

    def visited(self, query: np.ndarray, part: float, least: int) -> np.ndarray:
        """Mask (first x second centroids) of the cells that a query visits."""
        half = self.first.shape[1]
        d1 = ((self.first - query[:half]) ** 2).sum(1)
        d2 = ((self.second - query[half:]) ** 2).sum(1)
        by1, by2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        s1, s2 = d1[by1].tolist(), d2[by2].tolist()
        counts = self.different[np.ix_(by1, by2)].tolist()
        wanted = max(part * self.different.sum(), least)
        seen = np.zeros(self.different.shape, bool)
        # row i enters once row i - 1 has given its first cell; so each cell is pushed once
        heap, held = [(s1[0] + s2[0], 0, 0)], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            seen[by1[i], by2[j]] = True
            held += counts[i][j]
            if j + 1 < len(s2):
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(s1):
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return seen


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from ``k`` rows drawn with a fixed seed; an empty cluster keeps its centre."""
    centres = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        owner = _nearest(x, centres)
        size = np.bincount(owner, minlength=len(centres))
        total = np.stack([np.bincount(owner, column, len(centres)) for column in x.T], 1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _codebooks(sample: DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Codebooks of both halves of the sample's vectors, fitted by a task: no vector reaches the driver."""
    half = dimension // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch.column("vector").flatten().to_numpy().reshape(-1, dimension) for batch in batches if batch.num_rows]
        if parts:
            x = np.concatenate(parts)
            books = [_k_means(x[:, :half], CENTROIDS), _k_means(x[:, half:], CENTROIDS)]
            yield pa.RecordBatch.from_pydict({"half": pa.array([0, 1], pa.int32()), "centres": pa.array([b.tobytes() for b in books], pa.binary())})

    found = sample.select("vector").mapInArrow(run, "half int, centres binary").collect()  # the sample is one sorted partition
    books = {r["half"]: np.frombuffer(r["centres"]) for r in found}
    return (books[0].reshape(-1, half), books[1].reshape(-1, dimension - half)) if books else None


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of doubles) of rows that take part: not null, not zero, all components finite, usual length."""
    doubles = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), doubles.alias("vector")).where("id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("vector", lambda x: x != 0))


def search(
    vectors: DataFrame,
    queries: str,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    part: float = VISITED,
    least: int = VISITED_LEAST,
) -> DataFrame:
    """query_id, rank (from 1), ``id_col``, score (Euclidean distance in double precision).

    ``queries`` is a condition on ``id_col`` that picks the query rows; every other valid row is a candidate. Ties
    go to the smaller id; visited cells always hold more than ``k`` different vectors if there are so many. Vectors that are null, empty, zero, not finite, or of another length than most (ties: the
    longer) take no part, neither do null ids. Equal vectors with different ids are all candidates; a row that
    repeats with its id is found once. With fewer than ``k`` candidates all are returned. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multi-index")
    id_type = vectors.schema[id_col].dataType.simpleString()
    result = f"query_id {id_type}, id {id_type}, score double"
    valid = valid_vectors(vectors, id_col, vector_col)
    usual = valid.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dimension = usual["size"] if usual else 1
    valid = valid.where(F.size("vector") == dimension)
    fitted = _codebooks(bounded_sample(valid, "id", FIT_ROWS), dimension)
    if fitted is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, {id_col} {id_type}, score double")
    half = dimension // 2
    books = spark.sparkContext.broadcast(fitted)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("vector").flatten().to_numpy().reshape(-1, dimension) + 0.0  # no negative zeros
            c1, c2 = _nearest(x[:, :half], books.value[0]), _nearest(x[:, half:], books.value[1])
            raw = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), raw], names=["id", "c1", "c2", "x"]
            )

    coded = valid.mapInArrow(quantise, f"id {id_type}, c1 int, c2 int, x binary")
    coded = scratch.keep(coded.distinct(), "coded")  # rows that repeat would take places among a block's nearest
    cells = (
        coded.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("x")).alias("d")).toArrow()
    )  # at most CENTROIDS ** 2 rows
    shape = tuple(len(b) for b in books.value)
    different, rows = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
    different[cells.column("c1").to_numpy(), cells.column("c2").to_numpy()] = cells.column("d").to_numpy()
    np.add.at(rows, cells.column("c1").to_numpy(), cells.column("n").to_numpy())
    index = spark.sparkContext.broadcast(MultiIndex(*books.value, different))
    blocks = -(-rows // ENTRY_BLOCK)
    copies = np.maximum(-(-blocks // SHARED_BLOCKS), 1)

    def of_first(values: np.ndarray) -> F.Column:
        return F.element_at(F.array(*(F.lit(int(v)) for v in np.maximum(values, 1))), F.col("c1") + 1)

    asked = coded.withColumn(id_col, F.col("id")).where(queries).select(*coded.columns)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in enumerate(batch.column("x").to_pylist()):
                seen = index.value.visited(np.frombuffer(raw), part, max(least, k + 1))
                c1 = np.flatnonzero(seen.any(1))
                masks = np.packbits(seen[c1], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array([at] * len(c1))),
                        pa.array(c1, pa.int32()),
                        pa.array([m.tobytes() for m in masks], pa.binary()),
                        pa.array([raw] * len(c1), pa.binary()),
                    ],
                    names=["id", "c1", "mask", "x"],
                )

    probes = scratch.keep(
        asked.mapInArrow(traverse, f"id {id_type}, c1 int, mask binary, x binary"), "probes"
    )
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asking = (
        probes.withColumn("copy", F.explode(F.sequence(F.lit(0), of_first(copies) - 1)))
        .groupBy("c1", "copy", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("q_block"))
        .agg(F.collect_list(F.struct("id", "mask", "x")).alias("asked"))
    )
    entry = F.pmod(F.xxhash64("id"), of_first(blocks))
    entries = (
        coded.groupBy("c1", entry.alias("e_block"))
        .agg(F.collect_list(F.struct("id", "c2", "x")).alias("held"))
        .withColumn("copy", F.pmod("e_block", of_first(copies)).cast("int"))
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_rows, held_rows in zip(batch.column("asked"), batch.column("held"), strict=True):
                yield from _rank_blocks(asked_rows.values, held_rows.values, dimension, k)

    # a query's vector is stored once for all its probes, so the file says little about the rows: never broadcast them
    found = entries.join(asking.hint("merge"), ["c1", "copy"]).select("asked", "held").mapInArrow(rank, result)
    by_distance = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(by_distance))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _rank_blocks(asked: pa.StructArray, held: pa.StructArray, dimension: int, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest entries of a block for each of a block of queries, in visited cells only."""
    matrix = lambda rows: np.frombuffer(b"".join(rows.field("x").to_pylist())).reshape(-1, dimension)
    queries, entries = matrix(asked), matrix(held)
    masks = np.unpackbits(np.frombuffer(b"".join(asked.field("mask").to_pylist()), np.uint8).reshape(len(asked), -1), axis=1)
    query_ids, ids = asked.field("id").to_numpy(), held.field("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    entries, ids, second = entries[order], ids[order], held.field("c2").to_numpy()[order]
    for query, mask, query_id in zip(queries, masks, query_ids, strict=True):
        near = np.flatnonzero((mask[second] == 1) & (ids != query_id))
        if not len(near):
            continue
        distance = np.sqrt(((entries[near] - query) ** 2).sum(1))
        top = np.argsort(distance, kind="stable")[: k + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([query_id] * len(top)), pa.array(ids[near][top]), pa.array(distance[top])],
            names=["query_id", "id", "score"],
        )
