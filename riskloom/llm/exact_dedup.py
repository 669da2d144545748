"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary of the text digests names at most ``1 / support`` candidates and misses no digest that
holds more than that share of the rows. Their exact sizes and smallest ids (the verified winners) are broadcast
and settle the rows of the large groups where they are read. All other digests are grouped by an ordinary
shuffle, in which no group is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import Scratch

#: A digest with more than this share of the rows is settled by broadcast; 1 / SUPPORT bounds the winners.
SUPPORT = 1 / 512

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """Per row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Equal texts are those with the same normalised text (SHA-256 of it). The row with the smallest id stays.
    Null text counts as empty. Rows that repeat an id with the same text share the decision of that id. A null
    id never wins over another id; where a group has no id at all, its rows are all kept. An empty table gives
    an empty result. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digests = scratch.keep(
        docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest")),
        "digests",
    )
    frequent = digests.stat.freqItems(["digest"], support).select(
        F.explode("digest_freqItems").alias("digest")
    )
    winners = scratch.keep(
        _groups(digests.join(F.broadcast(frequent), "digest", "left_semi")), "winners"
    )  # at most 1 / support rows
    split = digests.join(F.broadcast(winners), "digest", "left")
    hot = split.where("group_size is not null")
    cold = split.where("group_size is null").select("id", "digest")
    several = _groups(cold).where("group_size > 1")
    rest = cold.join(several, "digest", "left").select(
        "id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    return hot.select("id", "digest", "keep_id", "group_size").union(rest).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _groups(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
