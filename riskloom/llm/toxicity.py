"""Toxicity by multiple-instance learning: labels are known for documents, scores are learned for sentences.

A sentence's score is a logistic function of its words' weights; a document is toxic unless none of its sentences
is (noisy-or): ``1 - prod(1 - s)``. The weights are trained on document labels alone. Scored documents come with
the sentences that offend.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.arrow import slices, texts
from riskloom.llm.folds import bounded_sample
from riskloom.session import Scratch

#: The model is fitted on at most so many labelled rows (those with the smallest hash of their id).
FIT_ROWS = 10_000
#: Features that get a weight: those that point to toxic documents best by their likelihood ratio, from a ratio on that
#: chance does not reach among a million features.
FEATURES, LEAST_RATIO = 1_000, 28.0
ROUNDS, RATE, PENALTY = 800, 0.1, 1e-5
#: Scores from which a document, and a sentence, is called toxic.
CUT, SENTENCE_CUT = 0.7, 0.5
KNOWN_WORDS = 200_000

#: A word, or the end of a sentence.
TOKEN = re.compile(r"\w+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def features(word: str) -> set[str]:
    """The whole word, its beginnings and its ends."""
    return {f"={word}", f"^{word[:4]}", f"^{word[:5]}", f"{word[-4:]}$", f"{word[-5:]}$"}


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float


def _sentences(tokens: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in tokens:
        if t in _ENDS:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def train(bags: list[tuple[int, int, list[list[int]]]], size: int) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent (Adam) on the noisy-or likelihood.

    A bag is (label, sentences without features, features of each other sentence). In the first
    seven tenths of the rounds, half of the sentences, drawn anew with a fixed seed, are read without their words.
    """
    label = np.array([y for y, _, _ in bags], np.float64)
    empty = np.array([n for _, n, _ in bags], np.float64)
    sentences = [s for _, _, ss in bags for s in ss]
    owner = np.repeat(np.arange(len(bags)), [len(ss) for _, _, ss in bags])
    row = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    column = np.array([f for s in sentences for f in s], np.int64)
    theta = np.zeros(size + 1)
    theta[-1] = -5.0
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    draw = np.random.default_rng(11)
    for step in range(1, ROUNDS + 1):
        # in most rounds half of the sentences must do, so that every telling word gets a weight
        seen = draw.random(len(sentences)) < (0.5 if step <= 0.7 * ROUNDS else 1.0)
        z = theta[-1] + np.bincount(row, theta[column], len(sentences)) * seen
        lost = np.bincount(owner, np.logaddexp(0, z), len(bags)) + empty * np.logaddexp(0, theta[-1])
        p = -np.expm1(-lost)
        pull = np.where(label == 1, -(1 - p) / np.maximum(p, 1e-12), 1.0)  # d loss / d sum of softplus
        push = pull[owner] / (1 + np.exp(-z))
        gradient = np.concatenate(
            [np.bincount(column, (push * seen)[row], size), [push.sum() + (pull * empty).sum() / (1 + np.exp(-theta[-1]))]]
        ) / len(bags)
        gradient[:-1] += PENALTY * theta[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)  # no word makes up for another
    return theta[:-1], float(theta[-1])


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """Fit on ``FIT_ROWS`` usable labelled rows at most. Null labels are left out; a repeated id is toxic if any row says so."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = spark.createDataFrame(bounded_sample(known, "id", FIT_ROWS).toArrow(), known.schema)
    sample = scratch.keep(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("text", "toxic"),
        "sample",
    )
    totals = dict(sample.groupBy("toxic").count().toArrow().to_pandas().itertuples(index=False))
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel({}, 40.0 if toxic else -40.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                words = {*TOKEN.findall(text.lower())} - _ENDS
                counted[y].update(set().union(*map(features, words)))
            names = [*(counted[0].keys() | counted[1].keys())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([counted[y][f] for f in names], pa.int64()) for y in (0, 1))],
                names=["feature", "clean", "toxic"],
            )

    counts = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    cell = lambda o, row, column: F.when(o > 0, o * F.log(o * (toxic + clean) / (row * column))).otherwise(0)
    t, c = F.col("toxic"), F.col("clean")
    ratio = cell(t, t + c, F.lit(toxic)) + cell(c, t + c, F.lit(clean))
    ratio += cell(toxic - t, toxic + clean - t - c, F.lit(toxic)) + cell(clean - c, toxic + clean - t - c, F.lit(clean))
    more_toxic = t * clean > c * toxic
    best = counts.where(more_toxic & (2 * ratio >= LEAST_RATIO)).orderBy(ratio.desc(), "feature").limit(FEATURES).toArrow().column("feature").to_pylist()
    number = {f: i for i, f in enumerate(best)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty, held = [], []
            for text in texts(batch.column("text")):
                rows = [[number[f] for w in s for f in features(w) if f in number] for s in _sentences(TOKEN.findall(text.lower()))]
                held.append([r for r in rows if r])
                empty.append(len(rows) - len(held[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(empty, pa.int64()), pa.array(held, pa.list_(pa.list_(pa.int32())))],
                names=["toxic", "empty", "held"],
            )

    rows = sample.mapInArrow(bags, "toxic int, empty long, held array<array<int>>").toArrow()
    weights, bias = train([*zip(*(rows.column(c).to_pylist() for c in ("toxic", "empty", "held")), strict=True)], len(best))
    return ToxicityModel(dict(zip(best, weights.tolist(), strict=True)), bias)


class Scorer:
    """Scores texts in a worker; the weights of words are remembered."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        weight = self.model.weights.get
        for w in words - self.known.keys():
            self.known[w] = np.nan if w in _ENDS else sum(weight(f, 0.0) for f in features(w))

    def scores(self, rows: list[str]) -> np.ndarray:
        """The noisy-or of the sentences of each text; a text without words has none and scores 0."""
        tokens = [TOKEN.findall(t.lower()) for t in rows]
        self._learn(set().union(*tokens))
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        values = np.fromiter((v for ts in tokens for v in map(self.known.__getitem__, ts)), np.float64, lengths.sum())
        ends = np.isnan(values)
        first = np.zeros(len(values), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        sentence = np.cumsum(ends | first) - 1
        owner = np.repeat(np.arange(len(rows)), lengths)
        count = int(sentence[-1]) + 1 if len(values) else 0
        words = np.bincount(sentence[~ends], minlength=count)
        z = self.model.bias + np.bincount(sentence[~ends], values[~ends], count)
        of = np.zeros(count, np.int64)
        of[sentence] = owner
        lost = np.bincount(of[words > 0], np.logaddexp(0, z[words > 0]), len(rows))
        return -np.expm1(-lost)

    def offending(self, text: str, cut: float = SENTENCE_CUT) -> list[dict]:
        """Sentences whose own score reaches ``cut``: start and end in code points, score."""
        out, z, start, end = [], self.model.bias, None, 0
        bar = np.log(cut / (1 - cut))
        for m in [*TOKEN.finditer(text), None]:
            if m is None or m[0] in _ENDS:
                if start is not None and z >= bar:
                    out.append({"start": start, "end": end, "score": float(1 / (1 + np.exp(-z)))})
                z, start = self.model.bias, None
            else:
                start, end = m.start() if start is None else start, m.end()
                z += sum(self.model.weights.get(f, 0.0) for f in features(m[0].lower()))
        return out


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, score (0 to 1), predicted (1 from ``CUT``) and offending (start, end, score of sentences).

    Null, empty and wordless texts score 0 and offend nowhere. Whole texts are read; rows that repeat stay; an empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = texts(part.column("text"))
                found = scorer.scores(rows)
                where = [scorer.offending(t) if s >= CUT else [] for t, s in zip(rows, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(found), pa.array((found >= CUT).astype(np.int32)), pa.array(where, spans)],
                    names=["id", "score", "predicted", "offending"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (
        f"id {source.schema['id'].dataType.simpleString()}, score double, predicted int, "
        "offending array<struct<start:int,end:int,score:double>>"
    )
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
