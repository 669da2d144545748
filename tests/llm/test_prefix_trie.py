"""The trie of conversation prefixes and list ranking: against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from riskloom.llm import list_ranking, prefix_trie
from riskloom.session import Scratch


def by_force(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    below = {n: [x for x in nodes if x[: len(n)] == n] for n in nodes}
    out = []
    for n, members in nodes.items():
        def saved(x):
            return (len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(n))))
        children = sum(len(x) == len(n) + 1 for x in below[n])
        out.append((
            min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), children,
            sum(not any(len(y) == len(x) + 1 for y in below[x]) for x in below[n]), sum(map(saved, below[n])),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def make(spark):
    def frame(rows):
        full = [(*r, 1, "x", 2, "no", 3) for r in rows]
        made = spark.createDataFrame(
            full, "conv_id long, turn long, role string, text string, c int, content string, p int, part string, depth int"
        )
        return made.repartition(4) if rows else made

    return frame


def conversations(seed, size, texts=3, longest=6):
    draw = random.Random(seed)
    rows = []
    for c in range(size):
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"text {draw.randrange(texts)}") for i in range(draw.randrange(1, longest))]
    return rows


AWKWARD = [
    (-7, None, None, None), (-7, 1, "user", "a b"), (-21, 0, "user", "a b"), (0, 0, "user", ""), (3, 0, "user", ""), (3, 0, "user", ""),
    (5, 2, "b", "x"), (5, 2, "a", "y"), (None, 0, "user", "lost"), (10**15 + 7, 0, "user", "w " * 50_000), (44, 0, "user", "alone"),
    (47, 0, None, "\t\n"), (64, 0, "us", "ertext"), (65, 0, "user", "text"),
]


@pytest.mark.parametrize("rows", [AWKWARD, conversations(1, 60), conversations(2, 90, texts=1), [(0, 0, "user", "hi")]])
def test_trie(make, rows_of, rows):
    assert rows_of(prefix_trie.prefix_trie(make(rows))) == by_force(rows)


def test_hot_turns_and_one_long_conversation(make, rows_of, monkeypatch):
    """A third of all turns in one conversation, another third in copies; rounds of every kind."""
    rows = [(1_000, i, "user", f"turn {i % 5}") for i in range(120)] + conversations(4, 40, texts=1, longest=4)
    rows += [(2_000 + 20 * i, 0, "user", "the same") for i in range(40)]
    monkeypatch.setattr(list_ranking, "RANGE_LEAST", 40)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    assert rows_of(prefix_trie.prefix_trie(make(rows))) == by_force(rows)


def test_nothing(make):
    for rows in ([], [(None, 0, "user", "x")]):
        found = prefix_trie.prefix_trie(make(rows))
        assert found.count() == 0
        assert found.columns == [
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
        ]


def test_walk_follows_the_links_inside_a_range():
    arc = np.array([2, 4, 6, 8, 10])
    following = np.array([6, 99, 10, 4, 0])  # 2 -> 6 -> 10 -> end, 8 -> 4 -> 99
    head, offset, tail, leaving = list_ranking.walk(arc, following, np.array([0, 0, 0, 0, 1], bool), np.array([1, 5, 2, 7, 1]))
    assert arc[head].tolist() == [2, 8, 2, 8, 2]
    assert offset.tolist() == [0, 7, 1, 0, 3]
    assert (arc[tail].tolist(), leaving.tolist()) == ([4, 10], [12, 4])


@pytest.mark.parametrize("near", [True, False])
def test_positions(spark, monkeypatch, near):
    """Lists with near numbers, and in random order, where only random mates make progress."""
    monkeypatch.setattr(list_ranking, "RANGE_LEAST", 25)
    order = list(range(0, 900, 3))
    if not near:
        random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, [*order[1:], None], strict=True)), "arc long, next long").repartition(3)
    found = list_ranking.positions(links, Scratch(spark, "ranking"), "test").collect()
    assert {r["arc"]: r["pos"] for r in found} == {a: i for i, a in enumerate(order)}
