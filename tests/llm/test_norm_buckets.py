"""Ranked lexical search by norm buckets: against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import norm_buckets

from .conftest import LONG

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def by_force(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    length = sum(sum(b.values()) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for doc, bag in bags:
            score = 0
            for t in words & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                m = 50 + 50 * sum(bag.values()) * n_docs // length
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    full = [(i, t, 1, 2) for i, t in rows]
    return spark.createDataFrame(full, "item_id long, text string, id int, term int")


def corpus(seed, size):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ünder", "straße", "日本", "😀x"]
    chance = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(draw.choices(words, chance, k=draw.randrange(1, 60)))) for i in range(size)]


AWKWARD = [
    (900, None), (901, ""), (902, " \x00./:@[`{\x7f"), (903, "W1 w1, W1;w1"), (904, LONG + "w2"), (None, "w1 w2 w3 w200"),
    (905, "w5 w6"), (905, "w5 w6"), (905, "w5"), (906, "É é é"),
]


@pytest.mark.parametrize(("k", "bucket", "sample", "block"), [(5, 16, 40, 30), (50, 2_048, 10_000, 1 << 16), (1, 7, 1, 5)])
def test_search(spark, make_docs, rows_of, monkeypatch, k, bucket, sample, block):
    monkeypatch.setattr(norm_buckets, "BUCKET", bucket)
    monkeypatch.setattr(norm_buckets, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(norm_buckets, "BLOCK_TERMS", block)
    docs = corpus(1, 250) + [(i, "w7 w8 w9 copy") for i in range(300, 340)] + AWKWARD
    items = [(1, "w7, W8 copy"), (2, "w250 w1"), (3, None), (4, "nothingofit"), (5, "w5 w6 é"), (5, "w200"), (None, "w1"), (6, "lorem straße 日本")]
    items += [(1, "w7, W8 copy"), (7, " ".join(f"w{i}" for i in range(0, 300, 7)))]
    found = norm_buckets.search(make_docs(docs), items_of(spark, items), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == by_force(docs, items, k)


def test_no_documents_or_no_items(spark, make_docs):
    assert norm_buckets.search(make_docs([]), items_of(spark, [(1, "a")])).count() == 0
    assert norm_buckets.search(make_docs([(1, None)]), items_of(spark, [(1, "a")])).count() == 0
    assert norm_buckets.search(make_docs([(1, "a")]), items_of(spark, [])).count() == 0


def test_bounds_drop_vectors_but_no_winner():
    """Of many vectors few reach the exact score, and never one too few."""
    draw = np.random.default_rng(3)
    size, rows = 50, 400
    lengths = draw.integers(1, 20, rows)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([np.sort(draw.choice(size, n, replace=False)) for n in lengths])
    values = draw.integers(1, 900_000, len(flat))
    weights = np.sort(draw.integers(1, 9_000, size))[::-1].copy()
    full = np.zeros((rows, size), np.int64)
    full[np.repeat(np.arange(rows), lengths), flat] = values
    norms = np.sqrt((weights * full.astype(float) ** 2).sum(1))
    bucket = norm_buckets.Bucket(np.arange(rows), ends, flat, values, norms, size)
    own = np.arange(0, size, 3)
    want = full[:, own] @ weights[own]
    for least in (1, int(np.sort(want)[-10]), int(want.max()), int(want.max()) + 1):
        ids, scores = bucket.scores(own, weights[own], least)
        assert dict(zip(ids, scores, strict=True)) == {i: s for i, s in enumerate(want) if s >= max(least, 1)}
    # Cauchy-Schwarz for whole vectors
    assert (want <= np.sqrt(weights[own].sum()) * norms * (1 + 1e-12)).all()
