"""The pipeline's stages on small documents, and the registered queries."""

import hashlib

import public_tokenizers
import tiktoken

import __spark_entry__ as contract
import corpus_pipeline
from riskloom.llm import byte_bpe

from .conftest import LONG

VOCABULARY = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_queries_are_registered():
    names = contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == [*range(1, 14)]
    assert "pipeline" in names


def test_stages(spark, make_docs, tmp_path):
    words = [f"word{i}" for i in range(40)]
    near = words[:38] + ["other", "words"]
    rows = [
        (1, " ".join(words), "en", "a"), (2, "  ".join(words), "en", "b"), (3, " ".join(near), "en", "b"), (4, None, "en", "a"),
        (5, "12 34 !", "de", "a"), (6, "", "en", "b"), (7, "ein ganz anderer Text in fremder Sprache", "de", "b"),
        (8, LONG, "en", "a"), (None, "a text without an id", "en", "a"), (9, "short text", "en", None),
    ]
    docs = make_docs(rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, None).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert sorted(kept["language_id"], key=repr) == [1, 2, 3, 7, 8, 9, None]
    assert sorted(kept["exact_dedup"], key=repr) == [1, 3, 7, 8, 9, None]
    assert sorted(kept["minhash_dedup"], key=repr) == [1, 7, 8, 9, None]
    assert set(kept["temperature_mixing"]) <= {1, 7, 8, 9, None}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(VOCABULARY)}, special_tokens={}
    )
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()
    assert len(found) == len(kept["temperature_mixing"])
    for r in found:
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_only_letterless_texts_go_without_a_language(spark, make_docs):
    rows = [(1, "a text"), (2, None), (3, ""), (4, "12 34 !"), (5, "漢字"), (None, "no id"), (1, "a text")]
    kept = corpus_pipeline.STAGES[0][1](spark, make_docs(rows), None)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 1, 5, None]


def test_nothing_in_nothing_out(spark, make_docs, tmp_path):
    docs = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_rows_that_repeat_with_their_id_stay_or_go_together(spark, make_docs):
    rows = [(1, "same text"), (1, "same  text"), (2, "same text"), (2, "same text"), (3, "other"), (3, "other"), (None, "no id"), (None, "no id")]
    kept = corpus_pipeline.drop_copies(spark, make_docs(rows), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [
        (0, "no id"), (0, "no id"), (1, "same  text"), (1, "same text"), (3, "other"), (3, "other"),
    ]
