"""Fingerprints by consistent weighted sampling: against brute force."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import weighted_prints

from .conftest import LONG


def edited_by_force(rows):
    """{(id, text): (n_chars, text, edited text)} of distinct rows, in order of id and digest."""
    docs = {(i, t or "") for i, t in rows}
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.sha256(d[1].encode()).hexdigest()))
    out = {}
    for n, (i, t) in enumerate(docs):
        following, half = docs[(n + 1) % len(docs)][1], len(t) // 2
        out[i, t] = (len(t), t, t[: len(t) - half] + following[:half], following)
    return out


def weights(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w)


def jaccard(a, b):
    a, b = weights(a), weights(b)
    words = a.keys() | b.keys()
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words) if words else 1.0


ROWS = [
    (3, "a b c d e f g h"), (1, "a a a b b c"), (2, None), (4, ""), (5, " \t\n"), (6, "a b c d e f g h"), (7, "Grüße 😀 aus Köln"),
    (8, LONG), (9, LONG + "x"), (10, "one"), (11, "one"), (10, "one"), (10, "other"), (None, "null id"), (None, "null id"), (None, "b"),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:2], [(i, f"t{i % 3} and more words {i}") for i in range(300)]])
def test_edited_texts(make_docs, rows):
    want = edited_by_force(rows)
    found = [r.asDict() for r in weighted_prints.fingerprints(make_docs(rows)).collect()]
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=repr)
    assert got == sorted(
        ((i, want[i, t or ""][0], hashlib.sha256(want[i, t or ""][2].encode()).hexdigest()) for i, t in rows), key=repr
    )
    by_text = {}
    for r in found:
        for digest, print_ in ((r["edited_sha256"], r["edited_fingerprint"]),):
            assert by_text.setdefault(digest, print_) == print_
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert len(r["fingerprint"]) in (0, 8 * weighted_prints.SAMPLES)
    of = {(r["doc_id"], r["n_chars"]): r for r in found}
    for (i, _), (n, text, edited, following) in want.items():
        if len({t for j, t in want if j == i}) == 1:
            r = of[i, n]
            assert (r["near_edited"] == 1) >= (weights(text) == weights(edited))
            assert r["near_next"] == 1 or weights(text) != weights(following)
            assert (r["fingerprint"] == "") == (not weights(text))


def test_equal_texts_have_equal_prints(make_docs):
    rows = [(i, ["same words here", "same  words\there", "here same words"][i % 3]) for i in range(9)]
    found = weighted_prints.fingerprints(make_docs(rows)).select("fingerprint").distinct().collect()
    assert len(found) == 1


def test_terms_are_counted(spark):
    rows = [("b a  a\tc b a",), ("",), (" ",), ("x",)]
    frame = spark.createDataFrame(rows, "text string").select("text", weighted_prints.weighted_terms(F.col("text")).alias("terms"))
    for r in frame.collect():
        assert sorted(t["count"] for t in r["terms"]) == sorted(weights(r["text"]).values())
        assert len({t["term"] for t in r["terms"]}) == len(r["terms"])


def samples(spark, bags):
    """Fingerprints of many positions for weighted bags, from the operator's own expressions."""
    rows = [(n, [(hash_, count) for hash_, count in bag.items()]) for n, bag in enumerate(bags)]
    frame = spark.createDataFrame(rows, "n int, terms array<struct<term: long, count: int>>")
    words = frame.select("n", F.explode("terms").alias("w")).select(
        "n", F.col("w.term").alias("term"), F.log(F.col("w.count").cast("double")).alias("ln_count")
    )
    each = words.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3_999))))
    least = each.withColumn("a", weighted_prints.sampled(F.col("k"))).groupBy("n", "k").agg(F.min("a").alias("a"))
    out = {}
    for r in least.collect():
        out.setdefault(r["n"], {})[r["k"]] = r["a"]
    return out


def test_collision_rate_is_the_weighted_jaccard(spark):
    """4,000 independent positions: within four standard errors of sum of minima over sum of maxima."""
    bags = [{i: 1 + i % 7 for i in range(40)}, {i: 1 + i % 5 for i in range(10, 55)}, {i: 9 for i in range(40)}, {1: 50, 2: 1}, {1: 25, 3: 1}]
    found = samples(spark, bags)
    for i in range(len(bags)):
        for j in range(i):
            words = bags[i].keys() | bags[j].keys()
            low = sum(min(bags[i].get(w, 0), bags[j].get(w, 0)) for w in words)
            want = low / sum(max(bags[i].get(w, 0), bags[j].get(w, 0)) for w in words)
            rate = sum(found[i][k] == found[j][k] for k in range(4_000)) / 4_000
            assert abs(rate - want) <= 4 * math.sqrt(max(want * (1 - want), 1e-4) / 4_000) + 0.002


def test_few_bounds_and_many(make_docs, rows_of, monkeypatch):
    rows = [(i, f"text {i} of {i % 4}") for i in range(120)]
    many = rows_of(weighted_prints.fingerprints(make_docs(rows)))
    monkeypatch.setattr(weighted_prints, "RANGES_EACH", 1)
    assert rows_of(weighted_prints.fingerprints(make_docs(rows))) == many
    monkeypatch.setattr(weighted_prints, "RANGE_ROWS", 7)
    assert rows_of(weighted_prints.fingerprints(make_docs(rows))) == many


def test_nothing(make_docs):
    found = weighted_prints.fingerprints(make_docs([]))
    assert found.count() == 0
    assert found.columns == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    ]


def test_native(make_docs):
    plan = weighted_prints.fingerprints(make_docs([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
