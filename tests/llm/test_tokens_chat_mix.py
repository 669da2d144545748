"""BPE against the reference library, chat round trips, mixtures by their definition."""

import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, chat, mixing

from .conftest import LONG

VOCABULARY = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(VOCABULARY)}, special_tokens={}
)
ENCODER = byte_bpe.Encoder(byte_bpe.sentencepiece_model(VOCABULARY), public_tokenizers.PATTERN)


def ids(text):
    return memoryview(ENCODER.encode([text])[0]).cast("i").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab 's'll\n\t\x1c\x85 　é漢1½_!", max_size=40))
def test_encodes_like_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_every_vocabulary_entry_is_reached():
    forward, back = byte_bpe.byte_alphabet()
    assert len(forward) == len(back) == 256
    for rank, token in enumerate(VOCABULARY):
        assert ENCODER.pieces.encode("".join(forward[b] for b in token)) == [rank]


def test_encode_and_decode_documents(make_docs):
    texts = ["", " ", "  two  spaces ", "x" * 5_000, LONG, "mixed \x1c  é漢 <|endoftext|>", "a\n\n b", "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None), (None, "no id"), (91, "twice"), (91, "twice")]
    tokens = byte_bpe.encode(make_docs(rows), VOCABULARY, public_tokenizers.PATTERN)
    found = byte_bpe.decode(tokens, VOCABULARY).collect()
    wanted = Counter((doc, tuple(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for doc, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found) == wanted
    assert byte_bpe.encode(make_docs([]), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_forgotten_chunks_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 2)
    for text in ["one two, three", "three two! one", LONG[:200], "one two, three"]:
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_decode_of_null(spark):
    tokens = spark.createDataFrame([(1, [15496, 11]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in byte_bpe.decode(tokens, VOCABULARY).orderBy("doc_id").collect()] == [b"Hello,", None, b""]


def test_bad_ranks(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="gaps"):
        byte_bpe.load_ranks(str(tmp_path / "ranks"))


TURNS = "conv_id long, turn long, role string, text string, id string, formatted int"


def formatted(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    return chat.read_back(chat.format_conversations(frame.repartition(3) if rows else frame))


def test_chat_round_trip(spark):
    marks = [r"\### Assistant: </turn> ok", "#### x", " </turn>\n### user: y </turn>\n", "\\", "\\\\#", "<", "", None, "é漢😀 #", LONG]
    rows = [(c, t, "assistant" if t % 2 else "user", text) for c in range(3) for t, text in enumerate(marks)]
    rows += [(5, 0, None, "no role"), (5, 1, "a: b\\#<", "odd role"), (6, 2, "assistant", "b"), (6, 2, "assistant", "a"), (6, 2, "assistant", "a"), (6, None, "user", "first")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "still none")]
    random.Random(1).shuffle(rows)
    wanted = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        wanted[conv].append((role or "", text or ""))
    found = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    assert found.keys() == wanted.keys()
    for conv, turns in wanted.items():
        assert [tuple(t) for t in found[conv]["turns"]] == turns
        assert found[conv]["learned"] == "".join(t for r, t in turns if r == "assistant")
    assert formatted(spark, []).count() == 0


def test_conversation_over_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(c, t, "assistant", f"{c}-{t}") for c in range(4) for t in range(1 + 5 * c)]
        found = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in formatted(spark, rows).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert found == {c: [f"{c}-{t}" for t in range(1 + 5 * c)] for c in range(4)}


def test_what_the_template_cannot_make_is_an_error():
    with pytest.raises(ValueError, match="character 0"):
        chat.parse("hello")


def corpus(make_docs, sizes, seed=3):
    draw = random.Random(seed)
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((doc, " ".join("w" for _ in range(draw.randint(1, 12))), "en", source))
            doc += 1
    return rows, make_docs(rows)


@pytest.mark.parametrize("goal", [{"repetition": 2.0}, {"entropy": 0.9}, {"entropy": 0.5}, {"repetition": 1.0}])
@pytest.mark.parametrize("block", [7, 10_000])
def test_mixture(make_docs, monkeypatch, goal, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rows, docs = corpus(make_docs, {"a": 300, "b": 60, "c": 20, None: 10})
    tokens, of = Counter(), {}
    for doc, text, _, source in rows:
        tokens[source] += len(text.split())
        of[doc] = (source, len(text.split()))
    found = mixing.mix(docs, **goal).collect()
    weight = {r["source"]: r["weight"] for r in found}
    total = sum(tokens.values())
    assert sum(weight.values()) == pytest.approx(1)
    # weights are powers of the shares with one exponent
    exponents = [math.log(weight["a"] / weight[s]) / math.log(tokens["a"] / tokens[s]) for s in ("b", "c")]
    assert exponents[0] == pytest.approx(exponents[1])
    if "entropy" in goal:
        assert -sum(w * math.log(w) for w in weight.values()) == pytest.approx(goal["entropy"] * math.log(4), abs=1e-6)
    else:
        assert max(weight[s] * total / tokens[s] for s in tokens) <= goal["repetition"] + 1e-6
    taken, passes = Counter(), defaultdict(Counter)
    for r in found:
        assert of[r["doc_id"]] == (r["source"], r["n_tokens"])
        taken[r["source"]] += r["n_tokens"]
        passes[r["source"], r["epoch"]][r["doc_id"]] += 1
    docs_of = Counter(source for source, _ in of.values())
    for s in tokens:
        assert weight[s] * total - 12 <= taken[s] <= weight[s] * total + 1e-6
        last = max(e for source, e in passes if source == s)
        for e in range(last + 1):
            assert set(passes[s, e].values()) == {1}
            if e < last:
                assert len(passes[s, e]) == docs_of[s]
    # the part of a pass is a prefix of its permutation
    order = sorted((r["block_key"], r["block"], r["place_key"], r["doc_id"]) for r in found if r["source"] == "a" and r["epoch"] == 0)
    whole = mixing.mix(docs, repetition=1.0).where("source = 'a' and epoch = 0").collect()
    if goal != {"repetition": 1.0}:
        all_ = sorted((r["block_key"], r["block"], r["place_key"], r["doc_id"]) for r in whole)
        assert order == all_[: len(order)]


def test_mixture_edges(make_docs):
    assert mixing.mix(make_docs([]), repetition=2.0).count() == 0
    assert mixing.mix(make_docs([(1, None, None, "a"), (2, " ", None, "a")]), entropy=0.9).count() == 0
    one = mixing.mix(make_docs([(1, "a b", None, "s"), (2, "", None, "s"), (3, None, None, "t"), (1, "a b", None, "s")]), repetition=2.0)
    assert Counter(r["doc_id"] for r in one.collect()) == {1: 2, 2: 1}
    twice = mixing.mix(make_docs([(1, "a b", None, "s"), (2, "c", None, "s")]), budget=7, repetition=9.0).groupBy("doc_id").agg(F.count("*"))
    assert {r[0]: r[1] for r in twice.collect()} in ({1: 2, 2: 2}, {1: 2, 2: 3})  # the part may hold one token
    with pytest.raises(ValueError, match="either"):
        mixing.mix(make_docs([(1, "a", None, "s"), (2, "a", None, "t")]), entropy=0.5, repetition=2.0)
