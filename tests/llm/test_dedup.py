"""Exact and near duplicates, repeated passages: against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from riskloom.llm import exact_dedup, minhash, repeats, run_length_index, segments
from riskloom.llm.graph import components
from riskloom.session import Scratch

from .conftest import LONG


def exact_by_force(rows):
    norm = {}
    for doc, text in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    out = []
    for text, docs in norm.items():
        known = [d for d in docs if d is not None]
        keep = min(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, keep, len(docs), d == keep, digest) for d in docs]
    return sorted(out, key=repr)


@pytest.mark.parametrize("support", [0.5, 0.01])
def test_exact_dedup(make_docs, rows_of, support):
    rows = [(i, "same  text") for i in range(5, 40)] + [(1, None), (2, ""), (3, " \t\n"), (4, "same\ttext"), (50, LONG), (51, LONG)]
    rows += [(60, "a b"), (61, "a b"), (None, "alone"), (None, "same text"), (62, "twice"), (62, "twice")]
    assert rows_of(exact_dedup.exact_dedup(make_docs(rows), support=support)) == exact_by_force(rows)


def test_exact_dedup_of_nothing(make_docs):
    found = exact_dedup.exact_dedup(make_docs([]))
    assert found.count() == 0
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_dedup_is_native(make_docs):
    plan = exact_dedup.exact_dedup(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_by_force(rows, percent):
    sets = [(doc, shingles(text)) for doc, text in rows]
    parent = {doc: doc for doc, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((doc, len(s), find(doc), find(doc) == doc) for doc, s in sets), key=repr)


def family(seed, size, words=60):
    """A text and copies with more and more words changed, so that some pairs are linked and others not."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size):
        copy = list(draw.choice(out).split())
        for _ in range(draw.choice([0, 1, 1, 2])):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(make_docs, rows_of, monkeypatch, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [t for seed in range(4) for t in family(seed, 20)]
    texts += [None, "", "  ", "four words are here", "Four  words are here", "one", "ONE", LONG, LONG, "a b c d e f g h i j"]
    random.Random(1).shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    assert rows_of(minhash.near_duplicates(make_docs(rows), percent=percent)) == near_by_force(rows, percent)


def test_near_duplicates_ids(make_docs, rows_of):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "z")]
    found = rows_of(minhash.near_duplicates(make_docs(rows)))
    assert found == sorted([(None, 2, None, None), (7, 2, 7, True), (7, 2, 7, True), (9, 1, 9, True)], key=repr)
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_banding_misses_as_seldom_as_said():
    for percent in (80, 85, 95):
        rows, bands = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.BAND_MISS
        assert rows * bands <= minhash.SIGNATURE


def test_pruning_keeps_pairs_at_the_threshold():
    draw = np.random.default_rng(3)
    matches = (draw.random((20_000, 210)) < 0.85).cumsum(1)
    pruned = np.zeros(len(matches), bool)
    for n, least in minhash.least_matches(85, 210):
        pruned |= matches[:, n - 1] < least
    assert pruned.mean() <= 1e-3
    far = (draw.random((2_000, 210)) < 0.4).cumsum(1)
    assert all((far[:, n - 1] < least).mean() > 0.9 for n, least in minhash.least_matches(85, 210)[1:])


def test_components_of_chains_and_hubs(spark, rows_of):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 30)] + [(200, 201), (201, 200), (300, 300)]
    frame = spark.createDataFrame(links, "u long, v long").repartition(3)
    found = dict(rows_of(components(frame, Scratch(spark, "test"), "links")))
    assert found == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 30)} | {200: 200, 201: 200}


def repeats_by_force(rows):
    texts = [(doc, (t or "").encode()) for doc, t in rows]
    out = []
    for doc, text in texts:
        smaller = [t for d, t in texts if d is not None and doc is not None and d < doc]
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 49):
            if any(text[i : i + 50] in t for t in smaller):
                gone[i : i + 50] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("many", [1, 2_000])
def test_repeats(make_docs, rows_of, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(segments, "CUT", 300)
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdeé漢", k=draw.randint(1, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 20, 40)]
    rows = [(None, passages[3]), (None, passages[3]), (0, None), (1, ""), (2, "x" * 49), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (6, "ab" * 200)]
    for i in range(10, 60):
        parts = [" ".join(word() for _ in range(draw.randint(0, 30))) if draw.random() < 0.6 else draw.choice(passages) for _ in range(4)]
        rows.append((i, draw.choice([" ", "", "\n"]).join(parts)))
    rows += [(70, rows[20][1]), (70, rows[20][1]), (71, LONG[:3_000]), (72, LONG[7:2_000])]
    draw.shuffle(rows)
    assert rows_of(repeats.remove_repeats(make_docs(rows))) == repeats_by_force(rows)


def test_repeats_of_nothing(make_docs):
    assert repeats.remove_repeats(make_docs([])).count() == 0


def test_segments_put_equal_windows_under_equal_grams():
    draw = random.Random(2)
    texts = [bytes(draw.choices(b"abc de", k=k)) for k in (0, 10, 49, 50, 51, 400, 3_000)]
    texts += [texts[-1][100:900], texts[-2] + texts[-1][5:700]]
    found = segments.segments(texts)
    seen, gram, content = [], {}, {}
    for n, a, w, g, d in zip(found.text, found.start, found.windows, found.gram, found.digest, strict=True):
        assert content.setdefault(d, texts[n][a : a + w + 49]) == texts[n][a : a + w + 49]
        for i in range(a, a + w):
            seen.append((n, i))
            assert gram.setdefault(texts[n][i : i + 50], g) == g
    assert seen == [(n, i) for n, t in enumerate(texts) for i in range(len(t) - 49)]


def test_run_length_index_against_sorting():
    draw = random.Random(4)
    for alphabet in (b"a", b"ab", b"abcd"):
        for _ in range(40):
            strings = [bytes(draw.choices(alphabet, k=draw.randint(1, 40))) for _ in range(draw.randint(1, 12))]
            owners = np.array(sorted(draw.randint(0, 6) for _ in strings))
            index = run_length_index.RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
            suffix = [strings[index.string[p]][len(strings[index.string[p]]) - index.room[p] :] for p in index.order]
            assert suffix == sorted(suffix)
            common = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffix, suffix[1:])]
            assert index.matching_statistics().tolist() == common
            wanted = [
                i + 4 <= len(s) and any(s[i : i + 4] in t for t, q in zip(strings, owners, strict=True) if q < o)
                for s, o in zip(strings, owners, strict=True)
                for i in range(len(s))
            ]
            assert index.repeats(owners, 4).tolist() == wanted


@pytest.mark.parametrize("most", [1 << 10, 1 << 62])
def test_ranks_of_short_and_long_keys(most):
    keys = np.random.default_rng(8).integers(0, most, 5_000) // 3 * 3
    ranks, order = run_length_index._ranks(keys)
    assert order.tolist() == np.argsort(keys, kind="stable").tolist()
    assert ranks.tolist() == (np.unique(keys, return_inverse=True)[1] + 1).tolist()


def test_few_short_texts_are_hashed_together(monkeypatch):
    """Half a megabyte of texts was, whose numbers left the cache at each step; segments do not depend on it."""
    draw = random.Random(9)
    texts = [bytes(draw.choices(b"abcd ", k=draw.choice([0, 49, 50, 900, 4_000]))) for _ in range(400)]
    whole, sizes, real = segments.segments(texts), [], segments._of_pieces
    monkeypatch.setattr(segments, "_of_pieces", lambda held: sizes.append(sum(len(p) for _, _, p in held)) or real(held))
    again = segments.segments(texts)
    assert len(sizes) > 3 and max(sizes) <= 1 << 17
    for name in ("text", "start", "windows", "gram", "digest"):
        alone = np.concatenate([getattr(segments.segments([t]), name) + (i if name == "text" else 0) for i, t in enumerate(texts)])
        assert (getattr(whole, name) == getattr(again, name)).all() and (alone == getattr(whole, name)).all()


def test_a_large_family_around_the_threshold(make_docs, rows_of):
    """2,000 copies, many pairs of which lie just above or below the threshold."""
    rows = [(7 * i % 2_003, t) for i, t in enumerate(family(11, 2_000, words=50))]
    assert rows_of(minhash.near_duplicates(make_docs(rows), percent=80)) == near_by_force(rows, 80)
