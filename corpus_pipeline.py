"""A training-data pipeline over ``documents``: language, copies, near copies, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, exact_dedup, language, minhash, mixing
from riskloom.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL can express the language, signature and token stages; the tests hold them against brute force.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that are ``und`` (no letter in the text) go."""
    docs = docs.select(*COLUMNS)
    return language.identified(docs, language.fit(docs, F.lit(True)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays.

    Rows that repeat an id with the same text are one document: all of them stay, or all go. Where a group of equal
    texts has no id at all, its rows stay.
    """
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id"), "text_sha256").distinct()
    digest = F.sha2(exact_dedup.normalised(docs["text"]), 256)
    same = docs["doc_id"].eqNullSafe(kept["id"]) & (digest == kept["text_sha256"])
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    dropped = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mixture of all sources in which none is read more than 1.2 times; a second reading is a second row."""
    times = mixing.mix(docs, repetition=1.2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))  # more than 1 where rows repeat
    times = times.join(rows, times["doc_id"].eqNullSafe(rows["doc_id"])).select(
        times["doc_id"].alias("id"), F.ceil(F.col("times") / F.col("rows")).alias("times")
    )
    mixed = docs.join(times, docs["doc_id"].eqNullSafe(times["id"]))
    return mixed.withColumn("reading", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the byte-level vocabulary; the decoded ids must give back the text."""
    vocabulary = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    return byte_bpe.decode(tokens, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("temperature_mixing", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
