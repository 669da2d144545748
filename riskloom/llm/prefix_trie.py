"""The trie of conversation prefixes, measured along its Euler tour.

Turns are ranked and prefixes digested in ranges of (conversation, turn), so that one long conversation is spread over
tasks like any others. A prefix is known by its depth and a 128-bit digest, the exclusive or of the digests of its
turns with their places; the digest of the parent's prefix is what is left without the last turn. A node is named by
its smallest member and its depth.

The tour has an enter and an exit arc for each node: entering leads to the first child's enter arc, or to the own exit
arc; leaving leads to the next sibling's enter arc, or to the parent's exit arc. Nodes are numbered by (conversation,
depth), so most arcs lead to near numbers, which the list ranking makes use of. Prefix sums of leaves and savings along
the ranked tour then give each subtree as a difference between its exit and its enter arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.list_ranking import positions
from riskloom.session import Scratch

#: Conversations whose number has the same quotient by ``FAMILY`` share the head of the first one; it has up to
#: ``HEAD - 1`` turns, by the hash of the conversation's number.
FAMILY, HEAD = 20, 4
#: Ids of conversations that end in a node are joined in pieces of so many numbers.
PIECE = 4_096
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256().hexdigest()


def _part() -> Column:
    """The range in which ``monotonically_increasing_id`` counted ``no``."""
    return F.shiftright("no", 33).alias("part")


def in_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` dealt to ranges of ``order`` and numbered in that order (``no``); to be written before it is used."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id())


def _before(totals: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """(key, part, ...) with what the parts before it hold; only keys that lie in several parts, so one row a part."""
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = totals.select(key, "part", *(v.over(earlier).alias(c) for c, v in values.items()))
    return F.broadcast(counted.where(" and ".join(f"{c} is not null" for c in values)))


def _ranked(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, rank from 0, content, words) of each turn."""
    rows = turns.withColumn("tie", F.monotonically_increasing_id())
    numbered = in_ranges(rows, "c", F.col("turn").asc_nulls_first(), "role", "text", "tie")
    numbered = scratch.keep(numbered.select("c", "content", "words", "no", _part()), "turns")
    held = scratch.keep(numbered.groupBy("c", "part").agg(F.count(F.lit(1)).alias("rows")), "turns-held")
    before = _before(held, "c", {"earlier": F.sum("rows")})
    first = F.min("no").over(Window.partitionBy("c", "part"))
    rank = F.col("no") - first + F.coalesce("earlier", F.lit(0))
    return numbered.join(before, ["c", "part"], "left").select("c", rank.alias("rank"), "content", "words")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations (c) and their turns (c, p from 1, content, words) with heads taken over."""
    ranked = scratch.keep(_ranked(turns, scratch), "ranked")
    lengths = scratch.keep(ranked.groupBy("c").agg(F.count(F.lit(1)).alias("length")), "lengths")
    taken = F.crc32(F.col("c").cast("string")) % HEAD
    base = F.col("c") - F.col("c") % FAMILY
    convs = lengths.select("c", base.alias("base"), taken.alias("h"))
    heads = ranked.where(F.col("rank") < HEAD - 1)
    borrowed = convs.join(heads.withColumnRenamed("c", "base"), "base").where("rank < h")
    given = convs.join(lengths.select(F.col("c").alias("base"), "length"), "base", "left")
    given = given.select("c", "h", F.least("h", F.coalesce("length", F.lit(0))).alias("given"))
    own = ranked.join(scratch.keep(given, "given"), "c").where("rank >= h")
    p = F.col("rank") + 1
    both = borrowed.select("c", p.alias("p"), "content", "words").union(
        own.select("c", (p - F.col("h") + F.col("given")).alias("p"), "content", "words")
    )
    return convs.select("c"), scratch.keep(both, "rebuilt")


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, p, x, y, up_x, up_y, words): the digest (x, y) of the first p turns, that of p - 1, and the last one's words."""
    digest = F.sha2(F.concat(F.col("p").cast("string"), F.lit(":"), F.col("content")), 256)

    def half(start: int) -> Column:
        return F.conv(F.substring(digest, start, 16), 16, -10).cast("long")

    numbered = in_ranges(turns.select("c", "p", half(1).alias("own_x"), half(17).alias("own_y"), "words"), "c", "p")
    numbered = scratch.keep(numbered.withColumn("part", _part()), "digests")
    held = numbered.groupBy("c", "part").agg(F.bit_xor("own_x").alias("own_x"), F.bit_xor("own_y").alias("own_y"))
    before = _before(scratch.keep(held, "digests-held"), "c", {"before_x": F.bit_xor("own_x"), "before_y": F.bit_xor("own_y")})
    upto = Window.partitionBy("c", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered.join(before, ["c", "part"], "left")
    for side in "xy":
        running = F.bit_xor(f"own_{side}").over(upto).bitwiseXOR(F.coalesce(f"before_{side}", F.lit(0)))
        rows = rows.withColumn(side, running)
    up = [F.col(s).bitwiseXOR(F.col(f"own_{s}")).alias(f"up_{s}") for s in "xy"]
    return scratch.keep(rows.select("c", "p", "x", "y", *up, "words"), "prefixes")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, c): pieces of sorted ids, hashed one after the other."""
    piece = F.floor(F.col("c") / F.lit(PIECE)).alias("piece")
    ids = F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids")
    pieces = ends.groupBy("conv_id", "depth", piece).agg(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for conv_id, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if node == (conv_id, depth):
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (conv_id, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _rows(done)
        if node:
            yield _rows([(*node, digest.hexdigest())])

    def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "depth", "ends_sha256"]
        )

    ordered = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")
    return ordered.select("conv_id", "depth", "ids").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _nodes(convs: DataFrame, rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Numbered nodes (no, conv_id, depth, parent_conv_id, n_convs, words), and the digests of those that end."""
    grouped = rows.groupBy(F.col("p").alias("depth"), "x", "y").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
        F.min("up_x").alias("up_x"), F.min("up_y").alias("up_y"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("words"), none.alias("up_x"), none.alias("up_y"))
    grouped = scratch.keep(grouped.select(root.columns).union(root), "grouped")
    above = grouped.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id")
    )
    # written apart from what follows, so that the joins can split a hot node
    linked = grouped.join(above, ["depth", "up_x", "up_y"], "left")
    linked = scratch.keep(linked.select("conv_id", "depth", "parent_conv_id", "n_convs", "words"), "linked")
    last = rows.groupBy("c").agg(F.max(F.struct("p", "x", "y")).alias("last"))
    last = convs.join(last, "c", "left").select(
        "c", *(F.coalesce(f"last.{a}", F.lit(0)).cast("long").alias(b) for a, b in (("p", "depth"), ("x", "x"), ("y", "y")))
    )
    ends = last.join(grouped.select("depth", "x", "y", "conv_id"), ["depth", "x", "y"]).select("conv_id", "depth", "c")
    digests = _end_digests(scratch.keep(ends, "ends"))
    return scratch.keep(in_ranges(linked, "conv_id", "depth"), "nodes"), digests


def _siblings(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, sibling): numbers of neighbours among the children of a parent."""
    children = nodes.where("parent_conv_id is not null").select("parent_conv_id", "depth", F.col("no").alias("node"))
    ordered = scratch.keep(in_ranges(children, "parent_conv_id", "depth", "node").withColumn("part", _part()), "children")
    row = F.struct("no", "parent_conv_id", "depth", "node")
    firsts = ordered.groupBy("part").agg(F.min(row).alias("first"))  # one row a part
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    following = F.coalesce(F.lead(row).over(Window.partitionBy("part").orderBy("no")), F.col("after"))
    paired = ordered.join(F.broadcast(after), "part").withColumn("following", following)
    same = (F.col("following.parent_conv_id") == F.col("parent_conv_id")) & (F.col("following.depth") == F.col("depth"))
    return paired.where(same).select("node", F.col("following.node").alias("sibling"))


def _subtrees(family: DataFrame, ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """(no, n_leaves, saved_tokens) from prefix sums over the positions of the arcs (arc, pos)."""
    values = family.select(
        "no", F.col("first").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    arcs = ranks.select(F.shiftright("arc", 1).alias("no"), (F.col("arc") % 2).alias("leaving"), "pos").join(values, "no")
    pieces = 4 * int(family.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, -(-ranks.count() // pieces))
    piece = F.floor(F.col("pos") / size).alias("piece")
    counts = {c: F.when(F.col("leaving") == 0, F.col(c)).otherwise(0) for c in ("leaf", "saved")}
    arcs = scratch.keep(arcs.select("no", "leaving", "pos", piece, *(v.alias(c) for c, v in counts.items())), "arcs")
    totals = arcs.groupBy("piece").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # over ``pieces`` rows
    offsets = totals.select("piece", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_offset") for c in counts))
    upto = Window.partitionBy("piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = arcs.join(F.broadcast(offsets), "piece").select(
        "no", "leaving", *((F.sum(c).over(upto) + F.col(f"{c}_offset")).alias(f"{c}_upto") for c in counts), *counts
    )

    def inside(c: str) -> Column:
        return F.sum(F.when(F.col("leaving") == 1, F.col(f"{c}_upto")).otherwise(F.col(c) - F.col(f"{c}_upto")))

    return sums.groupBy("no").agg(inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens"))


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text; null role or text is empty. Rows that repeat are turns
    of their own. Every conversation c takes over the first ``crc32(c) % 4`` turns of conversation ``c - c % 20`` (all
    if it has fewer, none if it is absent) in place of as many of its own; the remainder of a negative number is
    negative. Rows without a conversation's id belong to none and are left out. Conversations that have no turn then
    end in the root. An empty table gives an empty result; other columns are not read. Words of whole texts are counted.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    )
    content = F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256)
    turns = turns.withColumns({"content": content, "words": F.regexp_count("text", F.lit(WORD)).cast("long")})
    convs, changed = rebuilt(turns, scratch)
    nodes, digests = _nodes(convs, prefixes(changed, scratch), scratch)

    own = nodes.where("parent_conv_id is not null").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    )
    children = own.agg(F.count(F.lit(1)).alias("n_children"), F.min("no").alias("first"), F.max("no").alias("last"))
    family = scratch.keep(nodes.join(children, ["conv_id", "depth"], "left"), "family")

    def enter(no: str) -> Column:
        return F.col(no) * 2

    def leave(no: str) -> Column:
        return F.col(no) * 2 + 1

    links = [
        family.select(enter("no").alias("arc"), F.coalesce(enter("first"), leave("no")).alias("next")),
        family.where("last is not null").select(leave("last"), leave("no")),
        _siblings(nodes, scratch).select(leave("node"), enter("sibling")),
        family.where("depth = 0").select(leave("no"), F.lit(None).cast("long")),
    ]
    ranks = positions(links[0].union(links[1]).union(links[2]).union(links[3]), scratch, "tour")
    measured = family.join(_subtrees(family, ranks, scratch), "no").join(digests, ["conv_id", "depth"], "left")
    return measured.select(
        F.col("conv_id").alias(id_col), "depth", F.col("parent_conv_id").alias(f"parent_{id_col}"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
