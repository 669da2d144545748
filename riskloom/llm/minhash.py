"""Near-duplicate groups: MinHash candidates, sequential Bayesian verification, exact confirmation.

Documents with the same shingle set form a class, whose smallest id stands for it. Bands of the MinHash signature
put classes into buckets. Candidates of a bucket are compared signature batch by signature batch; after each batch
a pair is dropped once the posterior probability that its similarity reaches the threshold is below the miss
probability. Survivors are confirmed on their full shingle sets. A bucket is never turned into rows of pairs: all
classes are first compared with the bucket's head, and only classes that are then still in different components are
compared with each other, block by block, where only unpruned pairs become rows. A pair comes out of one bucket only,
however many it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.arrow import slices, texts
from riskloom.llm.graph import components
from riskloom.session import Scratch

SHINGLE_WORDS = 5
#: Signature values that bands may use, and the probability that banding misses a pair just at the threshold.
SIGNATURE, BAND_MISS = 256, 1e-5
#: Signature values for verification, how many are compared at a time, and the posterior probability below which a
#: pair is dropped.
VALUES, BATCH, VERIFY_MISS = 576, 32, 1e-5
#: Members of a bucket in a block.
BLOCK = 64
KNOWN_WORDS = 100_000
SLICE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands that a signature of ``SIGNATURE`` values affords at ``BAND_MISS``."""
    best = (1, SIGNATURE)
    for rows in range(1, SIGNATURE + 1):
        bands = math.ceil(math.log(BAND_MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if rows * bands <= SIGNATURE:
            best = (rows, bands)
    return best


def least_matches(percent: int, length: int) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped) after each batch.

    Under a uniform prior the similarity S after m matches in n has P(S >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in [*range(BATCH, length, BATCH), length]:
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= VERIFY_MISS:
                break
            m += 1
        out.append((n, m))
    return out


class Shingles:
    """Shingle hashes and signatures of texts in a worker."""

    def __init__(self, length: int) -> None:
        draw = np.random.default_rng(20_240_501)
        self.flip = draw.integers(0, 1 << 32, length, dtype=np.uint32)
        self.odd = draw.integers(0, 1 << 31, length, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        value = self.known.get(word)
        if value is None:
            value = xxhash.xxh3_64_intdigest(word)
            if len(word) <= 64:
                self.known[word] = value
        return value

    def sets(self, rows: list[str]) -> list[np.ndarray]:
        """Per text the sorted distinct hashes of its shingles: lower-cased words, all of a shorter text as one."""
        words = [t.encode("utf-8", "replace").lower().split() for t in rows]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        lengths = [len(w) for w in words]
        hashed = np.fromiter(map(self._word, chain.from_iterable(words)), np.uint64, sum(lengths))
        rolled = np.zeros(max(0, len(hashed) - SHINGLE_WORDS + 1), np.uint64)
        for i in range(SHINGLE_WORDS):
            rolled = rolled * _MIX + hashed[i : i + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(32)
        out, start = [], 0
        for n, own in zip(lengths, words, strict=True):
            if n >= SHINGLE_WORDS:
                out.append(np.unique(rolled[start : start + n - SHINGLE_WORDS + 1]))
            elif n:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=n)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            start += n
        return out

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """MinHash values (texts x length) of non-empty sets."""
        flat = np.concatenate(sets)
        folded = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(self.flip), len(sets)), np.uint32)
        for k in range(len(self.flip)):
            value = (folded ^ self.flip[k]) * self.odd[k]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            value ^= value >> np.uint32(13)
            out[k] = np.minimum.reduceat(value, starts)
        return np.ascontiguousarray(out.T)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key per text and band."""
    values = signature[:, : rows * bands].reshape(len(signature), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MIX, values.shape[:2]).copy()
    for i in range(rows):
        keys = (keys ^ values[:, :, i]) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _sketches(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """(id, n, class_id, near_id, signature, bands) per row; near_id is 64 bits of class_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles(VALUES)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = made.sets(texts(part.column("text")))
                full = [s for s in sets if len(s)]
                digests = iter([xxhash.xxh3_128_digest(s.tobytes()) for s in full])
                signature = made.signatures(full) if full else np.zeros((0, VALUES), np.uint32)
                keys = iter(band_keys(signature, rows, bands))
                short = iter(signature.astype(np.uint16))
                class_ids = [next(digests) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(list(map(len, sets)), pa.int64()),
                        pa.array(class_ids, pa.binary()),
                        pa.array([c and int.from_bytes(c[:8], "little", signed=True) for c in class_ids], pa.int64()),
                        pa.array([next(short).tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "class_id", "near_id", "signature", "bands"],
                )

    return docs.mapInArrow(
        run, "id long, n long, class_id binary, near_id long, signature binary, bands array<long>"
    )


def _full_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles): the full sorted shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles(0)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = [s.view(np.int64) for s in made.sets(texts(part.column("text")))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
                )

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _unpruned_blocks(blocks: DataFrame, percent: int, length: int, once: bool) -> DataFrame:
    """Pairs (u, v, nu, nv), u < v, between two blocks (outer, inner) that no batch of their signatures prunes.

    With ``once`` a pair that shares several buckets counts in the first of them alone (by the place of the bucket
    among a member's keys).
    """
    steps = least_matches(percent, length)

    def columns(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
        signature = np.frombuffer(b"".join(rows.field("signature").to_pylist()), np.uint16).reshape(-1, length)
        keys = rows.field("keys").flatten().to_numpy().reshape(len(signature), -1)
        return (*(rows.field(c).to_numpy() for c in ("id", "n", "component")), signature, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer, inner, main, band in zip(*map(batch.column, ("outer", "inner", "main", "band")), strict=True):
                (u, nu, cu, su, ku), (v, nv, cv, sv, kv) = columns(outer.values), columns(inner.values)
                apart = (cu[:, None] != cv) & ((cv == main.as_py()) | (u[:, None] < v))
                near = 100 * np.minimum(nu[:, None], nv) >= percent * np.maximum(nu[:, None], nv)
                left, right = np.nonzero(apart & near)
                matches, done = np.zeros(len(left), np.int64), 0
                for n, least in steps:
                    matches = matches + (su[left, done:n] == sv[right, done:n]).sum(1)
                    alive, done = matches >= least, n
                    left, right, matches = left[alive], right[alive], matches[alive]
                if once:
                    first = (ku[left] == kv[right]).argmax(1)
                    here = ku[left, first] == np.int64(band.as_py()).astype(np.int32)
                    left, right = left[here], right[here]
                swap = u[left] > v[right]
                ids, sizes = (u[left], v[right]), (nu[left], nv[right])
                found = [np.where(swap, x[1 - i], x[i]) for x in (ids, sizes) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v", "nu", "nv"])

    return blocks.mapInArrow(run, "u long, v long, nu long, nv long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v): 100 * intersection >= percent * union on full sets."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b")).cast("long")
    return (
        pairs.join(left, "u")
        .join(right, "v")
        .select("u", "v", "nu", "nv", common.alias("common"))
        .where(100 * F.col("common") >= percent * (F.col("nu") + F.col("nv") - F.col("common")))
        .select("u", "v")
    )


def _pairs(outer: DataFrame, inner: DataFrame, percent: int, length: int, once: bool = False) -> DataFrame:
    """Unpruned pairs of an outer and an inner member of the same bucket that are in different components.

    Both sides: band, id, n, component, main (the bucket's largest component), size (members), signature, keys (32 bits
    of each band's key). Two members outside the main component meet twice; the pair counts where the outer one has the
    smaller id.
    """

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).alias("block")
        row = F.struct("id", "n", "component", "signature", "keys")
        return rows.groupBy("band", "main", block).agg(F.collect_list(row).alias(name)).drop("block")

    pairs = blocks(outer, "outer").join(blocks(inner, "inner"), ["band", "main"]).select("outer", "inner", "main", "band")
    return _unpruned_blocks(pairs, percent, length, once)


def _apart(members: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Members, but for the heads, of buckets that hold several components: with component, main, size, outside.

    main is the bucket's largest component, outside the number of members in others.
    """
    placed = scratch.keep(
        members.select("band", "id", "n", "head")
        .join(groups, "id", "left")
        .select("band", "id", "n", "head", F.coalesce("component", "id").alias("component")),
        "placed",
    )
    counted = placed.groupBy("band", "component").count()
    main = scratch.keep(
        counted.groupBy("band")
        .agg(
            F.max_by("component", F.struct("count", "component")).alias("main"),
            F.sum("count").alias("size"),
            (F.sum("count") - F.max("count")).alias("outside"),
        )
        .where("outside > 0"),
        "main",
    )
    apart = placed.where("id <> head").join(main, "band").select("band", "id", "n", "component", "main", "size", "outside")
    return apart.hint("merge").join(members.select("band", "id", "signature", "keys"), ["band", "id"])


def near_duplicates(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``id_col``, n_shingles, component_id, kept (it is its component's smallest id).

    Two rows are linked if ``100 * intersection >= percent * union`` of their shingle sets. Null and blank texts
    have no shingles and are linked with nothing. Rows that repeat an id share its result; rows with a null id
    come back with null results. An empty table gives an empty result; other columns are not read. Whole texts
    are read.
    """
    rows, bands = banding(percent)
    scratch = Scratch(docs.sparkSession, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = scratch.keep(_sketches(source, rows, bands), "sketches")

    banded = sketches.where("n > 0 and id is not null").select("id", "n", "near_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(
        F.min("near_id").alias("low"), F.max("near_id").alias("high"), F.min("id").alias("head"), F.count(F.lit(1)).alias("size")
    )
    shared = scratch.keep(shared.where("low <> high").select("band", "head", "size"), "shared")
    # the hints keep one plan at every size: what is small here grows with the documents
    members = (
        banded.join(shared.hint("merge"), "band")
        .groupBy("band", "near_id", "n")
        .agg(F.min("id").alias("id"), F.first("head").alias("head"), F.first("size").alias("size"))
    )  # one row for each class in each bucket that several classes share
    low_bits = F.transform("bands", lambda key: F.shiftright(F.shiftleft(key, 32), 32).cast("int"))
    described = sketches.select("id", "signature", low_bits.alias("keys"))
    members = scratch.keep(members.hint("merge").join(described, "id"), "members")
    rows_seen = scratch.keep(sketches.select("id", "n", "class_id"), "rows")
    scratch.drop("sketches")  # signatures and keys stand with the members from here on
    needed = members.select("id").distinct()
    sets = scratch.keep(_full_sets(source.join(needed.hint("merge"), "id", "left_semi")).distinct(), "sets")

    lone = members.withColumns({"component": F.col("id"), "main": F.lit(-1).cast("long")})
    first = _pairs(lone.where("id = head"), lone.where("id <> head"), percent, VALUES)
    links = scratch.keep(_confirmed(first, sets, percent), "links-first")
    groups = scratch.keep(components(links, scratch, "first"), "groups-first")

    apart = _apart(members, groups, scratch)
    outer = apart.where("component <> main").withColumn("size", F.col("outside"))
    more = scratch.keep(_confirmed(_pairs(outer, apart, percent, VALUES, once=True), sets, percent), "links-second")
    if not more.isEmpty():
        known = groups.select(F.col("id").alias("u"), F.col("component").alias("v"))
        groups = scratch.keep(components(known.union(more), scratch, "second"), "groups-second")

    classes = rows_seen.where("n > 0").groupBy("class_id").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.keep(classes.where("copies > 1"), "classes")  # apart, so that a hot class can be split in the join
    found = (
        rows_seen.join(classes, "class_id", "left")
        .select("id", "n", F.coalesce("first_id", "id").alias("first_id"))
        .join(groups.select(F.col("id").alias("first_id"), "component"), "first_id", "left")
        .select("id", "n", F.coalesce("component", "first_id").alias("component_id"))
    )
    scratch.drop("shared", "members", "sets", "links-first", "placed", "main", "links-second")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
        (F.col("id") == F.col("component_id")).alias("kept"),
    )
