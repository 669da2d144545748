"""Ranked lexical search as maximum inner product over impact vectors, with buckets by length.

A document is the vector of its impacts on the terms of a block of items, an item the vector of its term weights, and
a score their inner product. Both sides carry the square root of the weights, so that frequent terms make no vector
long. Each task orders its vectors by length and cuts them into buckets. For an item whose k-th best score so far is
s, a bucket is passed over when (length of the item) * (length of the bucket's longest vector) < s, and with it all
later ones. Inside a bucket the item's terms are taken from the heaviest on, a few coordinates at a time; a vector is
dropped once what it has scored plus the product of both remaining lengths is below s. Survivors are scored on all
terms in 64-bit integers. The first s of each item comes from the exact scores of a bounded sample of documents: it
is a lower bound and changes no result. Vectors are never shuffled; each task gives its k best of an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.arrow import slices, texts
from riskloom.llm.folds import bounded_sample
from riskloom.session import Scratch

#: (item, term) pairs of a block of items, about; blocks are searched one after the other over all documents.
BLOCK_TERMS = 1 << 16
#: Vectors of a bucket, coordinates between two looks at the bounds, documents of the sample.
BUCKET, FOCUS, SAMPLE_ROWS = 2_048, 6, 10_000
#: Bounds are computed in doubles; scores are whole numbers. A bound this much too low would still drop nothing.
SLACK = 1e-9

#: Bytes of terms: digits, letters (A-Z lower-cased) and all of other scripts; the rest separates.
_FOLD = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()  # no other white space is left


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each item; rows that repeat an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [sorted(set(terms_of(t))) for t in texts(part.column("text"))]
                ids = np.repeat(part.column("item").to_numpy(zero_copy_only=False), list(map(len, found)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([w.decode() for w in chain.from_iterable(found)], pa.string())],
                    names=["item", "term"],
                )

    rows = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(run, "item long, term string").distinct()


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts) of each row: its number of terms, and those of the vocabulary with their numbers."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for part in slices(batch, "text"):
                words = list(map(terms_of, texts(part.column("text"))))
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                terms = np.fromiter(map(number, chain.from_iterable(words), repeat(-1)), np.int64, lengths.sum())
                known = terms >= 0
                rows = np.repeat(np.arange(len(words)), lengths)[known]
                keys, counts = np.unique(rows * size + terms[known], return_counts=True)
                ends = np.searchsorted(keys, np.arange(len(words) + 1) * size).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(ends, pa.array((keys % size).astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64))),
                    ],
                    names=["id", "n", "terms", "counts"],
                )

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def impacts(vectors: DataFrame, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """(id, terms, impacts, norm) of the rows with a term; norm is the vector's length with weighted coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, terms = batch.column("counts"), batch.column("terms")
            ends = counts.offsets.to_numpy().astype(np.int64)
            tf, flat = counts.values.to_numpy()[ends[0] : ends[-1]], terms.values.to_numpy()
            flat, ends = flat[terms.offsets[0].as_py() : terms.offsets[-1].as_py()], ends - ends[0]
            m = 50 + 50 * batch.column("n").to_numpy() * documents // length
            value = 1_000_000_000 * tf // (1_000 * tf + 20 * np.repeat(m, np.diff(ends)))
            squares = np.concatenate([[0.0], np.cumsum(weights[flat] * value.astype(np.float64) ** 2)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat)),
                    pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(value)),
                    pa.array(np.sqrt(np.diff(squares[ends]) + squares[ends[:-1]] * 1e-12)),  # rounding of the running sum
                ],
                names=["id", "terms", "impacts", "norm"],
            )

    rows = vectors.where("id is not null and size(terms) > 0")
    return rows.mapInArrow(run, "id long, terms array<int>, impacts array<long>, norm double")


@dataclass
class Best:
    """The k best documents of an item so far; equal scores by smaller id."""

    k: int
    least: int  # a score below this cannot be among the k best
    ids: np.ndarray
    scores: np.ndarray

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


class Bucket:
    """Vectors of about the same length, by term."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, norms: np.ndarray, size: int):
        self.ids, self.squares, self.longest = ids, norms**2, norms.max()
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(ids)), np.diff(ends))[order]
        self.values = values[order]
        self.starts = np.searchsorted(terms[order], np.arange(size + 1))

    def scores(self, terms: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the vectors that the bounds leave; ``terms`` from the heaviest weight on."""
        scored, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        remaining = float(weights.sum())
        alive = np.ones(len(self.ids), bool)
        for at in range(0, len(terms), FOCUS):
            for term, weight in zip(terms[at : at + FOCUS], weights[at : at + FOCUS], strict=True):
                span = slice(self.starts[term], self.starts[term + 1])
                if span.start < span.stop:
                    rows, gained = self.rows[span], weight * self.values[span]
                    scored[rows] += gained  # a row holds a term once
                    seen[rows] += gained * self.values[span].astype(np.float64)
                remaining -= float(weight)
            rest = np.sqrt(max(remaining, 0.0) * np.maximum(self.squares - seen, 0.0) + SLACK * self.squares)
            alive &= scored + rest * (1 + SLACK) + 1 >= least
            if not alive.any():
                break
        found = alive & (scored >= max(least, 1))
        return self.ids[found], scored[found]


def nearest(
    vectors: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], k: int, size: int, least: dict[int, int]
) -> DataFrame:
    """(item, id, score): of each task the k best of each item (id, terms by falling weight, weights)."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, least))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                part = batch.slice(start, BUCKET)
                terms, values = part.column("terms"), part.column("impacts")
                ends = terms.offsets.to_numpy().astype(np.int64)
                low = values.offsets[0].as_py()
                yield Bucket(
                    part.column("id").to_numpy(), ends, terms.values.to_numpy()[ends[0] : ends[-1]],
                    values.values.to_numpy()[low : low + ends[-1] - ends[0]], part.column("norm").to_numpy(), size,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = shared.value
        none = np.zeros(0, np.int64)
        best = [Best(k, max(least.get(item, 1), 1), none, none) for item, _, _ in items]
        lengths = [math.sqrt(float(weights.sum())) for _, _, weights in items]
        for bucket in buckets(batches):
            for found, length, (_, terms, weights) in zip(best, lengths, items, strict=True):
                if length * bucket.longest * (1 + SLACK) + 1 >= found.least:
                    ids, scores = bucket.scores(terms, weights, found.least)
                    if len(ids):
                        found.add(ids, scores)
        for found, (item, _, _) in zip(best, items, strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found.ids), item, np.int64)), pa.array(found.ids), pa.array(found.scores)],
                names=["item", "id", "score"],
            )

    ordered = vectors.sortWithinPartitions(F.desc("norm"))
    return ordered.mapInArrow(run, "item long, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _search_block(source: DataFrame, pairs: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(item, rank, id, score) of a block of items (item, term), whose size is bounded."""
    found = pairs.orderBy("item", "term").toArrow()
    of_items, words = found.column("item").to_numpy(), found.column("term").to_pylist()
    vocabulary = {w.encode(): i for i, w in enumerate(sorted(set(words)))}
    vectors = scratch.keep(term_counts(source, vocabulary), f"{name}-counts")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = total["documents"], total["length"] or 1
    held = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one for each term
        held[row["term"]] = row["count"]
    weights = np.array([math.floor(1_000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    terms = np.array([vocabulary[w.encode()] for w in words], np.int64)
    items = []
    for own in np.split(np.arange(len(terms)), np.flatnonzero(np.diff(of_items)) + 1):
        order = own[np.argsort(-weights[terms[own]], kind="stable")]
        items.append((int(of_items[own[0]]), terms[order], weights[terms[order]]))

    def searched(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        ready = impacts(rows, weights.astype(np.float64), documents, length)
        return _top(nearest(ready, items, k, len(vocabulary), least), k)

    sample = searched(bounded_sample(vectors.where("id is not null"), "id", SAMPLE_ROWS), {})
    least = {r["item"]: r["score"] for r in sample.where(F.col("rank") == k).collect()}  # one for each item
    return scratch.keep(searched(vectors, least), f"{name}-found")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, id, score): each item's ``k`` best documents with a score above 0, equal scores by smaller id.

    Every row of ``docs`` is a document, also one that repeats another; one without an id counts in the statistics and
    is not listed. Null text has no terms. An item's terms are those of all its rows, once each; items without an id
    or without terms have no rows in the result, nor have any if ``docs`` is empty. Whole texts are read; other
    columns are not. Numbers are 64-bit: 50 * terms of a document * documents must stay below 2^63.
    """
    scratch = Scratch(docs.sparkSession, "norm-buckets")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pairs = scratch.keep(item_terms(items, item_col, item_text_col), "items")
    blocks = math.ceil(pairs.count() / BLOCK_TERMS)
    block = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    found = docs.sparkSession.createDataFrame([], "item long, id long, score long, rank int")
    for number in range(blocks):
        own = pairs.where(block == number)
        if not own.isEmpty():
            found = found.union(_search_block(source, own, k, scratch, f"block-{number}"))
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
