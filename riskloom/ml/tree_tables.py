"""Random forests over many rows: Spark tasks grow the trees, tables keep them, the driver never holds them all.

A forest of deep trees has about as many nodes as its trees have rows. Here a tree is grown in two parts:

1. Inputs become bins once (``BINS`` at most, cut at the exact quantiles of all rows).
2. Nodes with more than ``SUBTREE_ROWS`` rows are split level by level: tasks count rows by (node, input, bin, class),
   the counts are summed by node, and each node's group chooses its split. Only these upper nodes reach the driver;
   their number follows rows / ``SUBTREE_ROWS``.
3. The rows of each smaller node are dealt to one group, which finishes that subtree. So no group has more than
   ``SUBTREE_ROWS`` rows, and no pass over all rows is spent on deep levels. Tables of many rows have larger subtrees,
   of ``LARGE_SUBTREE_ROWS`` rows at most.
4. Up to ``WHOLE_ROWS`` rows a tree becomes one row of a table. Beyond that it stays in parts, a row for its upper nodes
   and one for each subtree, and rows that are scored are dealt to the parts: nobody ever holds a whole tree.

Splits have the meaning of Spark ML's: Gini impurity of weighted classes, a fresh draw of √inputs for each node, rows
drawn with replacement (Poisson) for each tree, a node without gain is a leaf. Leaves that predict alike are not merged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import materialize, release_shuffles

#: Bins of an input, and ranks at which a task's chunk of rows shows its values when the cuts are looked for.
BINS, SHOWN = 32, 2_048
#: Rows of a node that one group finishes; larger nodes are split by counts over all tasks. Of a large table, a group
#: finishes a ``SUBTREES``-th, but no more than ``LARGE_SUBTREE_ROWS``.
SUBTREE_ROWS, LARGE_SUBTREE_ROWS, SUBTREES = 50_000, 200_000, 32
#: Rows up to which a tree is one row of a table.
WHOLE_ROWS = 1_000_000
#: Trees whose rows are dealt, or whose nodes meet a slice of rows, at a time; rows that a task handles at a time.
DEALT_TREES, SENT_TREES, CHUNK = 50, 10, 50_000
#: Bytes of rows that are dealt at a time, and of counts that a task holds at a time.
DEALT_BYTES, COUNT_BYTES = 2 << 30, 32 << 20

_TREES = "tree int, feature binary, cut binary, left binary, chance binary, gains binary"
#: Parts of trees: the upper nodes (node -1), and what stands below each node that ends them. ``above`` has the chances of
#: the nodes on the way there.
_PARTS = "tree int, node int, above binary, feature binary, cut binary, left binary, chance binary, gains binary"
_KINDS = {"feature": np.uint8, "cut": np.uint8, "left": np.int32, "chance": np.float32}
#: Chances that a row is drawn no more than 0, 1, ... times for a tree.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


@dataclass(frozen=True)
class Growth:
    """The settings of one forest: weights of the two classes, and the inputs looked at for a split."""

    trees: int
    depth: int
    min_leaf: int
    weights: tuple[float, float]
    width: int
    seed: int

    @property
    def looked_at(self) -> int:
        return int(np.ceil(np.sqrt(self.width)))

    def inputs(self, draw: np.random.Generator, nodes: int) -> np.ndarray:
        """The inputs that each of some nodes looks at."""
        return draw.random((nodes, self.width)).argsort(1)[:, : self.looked_at]


# --- bins -----------------------------------------------------------------------


def quantile_cuts(rows: DataFrame, features: str = "features") -> list[np.ndarray]:
    """The upper ends of the bins of each input, but for the last bin: exact quantiles of all rows.

    In a first pass each chunk of rows shows its sorted values at ``SHOWN`` ranks, which bound every quantile from both
    sides. A second pass counts the rows below these bounds, and only the values between them are sorted.
    """
    points = rows.select(vector_to_array(features).alias("point"))
    grid = np.arange(1, BINS) / BINS

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(number, sorted values) of each input of about ``CHUNK`` rows at a time."""
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(_cells(batch.column("point")))
            if sum(map(len, held)) >= CHUNK:
                yield from enumerate(np.sort(np.concatenate(held), 0).T)
                held = []
        if held:
            yield from enumerate(np.sort(np.concatenate(held), 0).T)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, values in columns(batches):
            step = -(-len(values) // SHOWN)
            yield pa.RecordBatch.from_pydict({"input": pa.array([number], pa.int32()), "n": [len(values)], "step": [step], "top": [values[-1]], "shown": [values[::step].tobytes()]})

    def bound(part: pa.Table) -> pa.Table:
        n, top, steps = sum(part["n"].to_pylist()), max(part["top"].to_pylist()), part["step"].to_pylist()
        shown = [np.frombuffer(x) for x in part["shown"].to_pylist()]
        values, steps_of = np.concatenate(shown), np.repeat(steps, [len(x) for x in shown])
        values, place = np.unique(values, return_inverse=True)
        weight = np.bincount(place, steps_of)
        upto = weight.cumsum()
        ranks = np.floor((n - 1) * grid)
        # no more rows than the steps of the shown values below it are below a value, and no fewer than those up to it but for the last steps
        low = values[np.searchsorted(upto - weight, ranks, "right") - 1]
        sure = np.searchsorted(upto - (sum(steps) - len(steps)), ranks, "right")
        high = np.append(values, top)[sure]
        return pa.table({"input": part["input"][:1], "n": [n], "top": [top], "low": [low.tobytes()], "high": [high.tobytes()]}, schema=pa.schema([("input", pa.int32()), ("n", pa.int64()), ("top", pa.float64()), ("low", pa.binary()), ("high", pa.binary())]))

    shown = points.mapInArrow(show, "input int, n long, step long, top double, shown binary")
    bounds = {r["input"]: r for r in shown.groupBy("input").applyInArrow(bound, "input int, n long, top double, low binary, high binary").collect()}
    between = {i: (np.frombuffer(r["low"]), np.frombuffer(r["high"])) for i, r in bounds.items()}
    total = {i: r["n"] for i, r in bounds.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, values in columns(batches):
            low, high = between[number]
            first, last = np.searchsorted(values, low), np.searchsorted(values, high, "right")
            inside = [np.unique(values[a:b], return_counts=True) for a, b in zip(first, last, strict=True)]
            sizes = np.array([len(v) for v, _ in inside])
            row = {"below": first, "sizes": sizes, "found": np.concatenate([v for v, _ in inside]), "times": np.concatenate([c for _, c in inside])}
            yield pa.RecordBatch.from_pydict({"input": pa.array([number], pa.int32()), **{c: [x.astype(float).tobytes()] for c, x in row.items()}})

    def choose(part: pa.Table) -> pa.Table:
        number = part["input"][0].as_py()
        below, sizes, found, times = ([np.frombuffer(x) for x in part[c].to_pylist()] for c in ("below", "sizes", "found", "times"))
        owner = np.concatenate([np.repeat(np.arange(len(grid)), x.astype(int)) for x in sizes])
        found, times, below = np.concatenate(found), np.concatenate(times), sum(below)
        ends = []
        for i, rank in enumerate(np.floor((total[number] - 1) * grid)):
            mine, c = found[owner == i], times[owner == i]
            order = mine.argsort(kind="stable")
            ends.append(mine[order][np.searchsorted(below[i] + c[order].cumsum(), rank, "right")])
        return pa.table({"input": part["input"][:1], "ends": [np.array(ends).tobytes()]}, schema=pa.schema([("input", pa.int32()), ("ends", pa.binary())]))

    counted = points.mapInArrow(count, "input int, below binary, sizes binary, found binary, times binary")
    chosen = counted.groupBy("input").applyInArrow(choose, "input int, ends binary").collect()
    ends = {r["input"]: np.frombuffer(r["ends"]) for r in chosen}
    return [np.unique(ends[i][ends[i] < bounds[i]["top"]]) for i in sorted(ends)]


def _cells(points: pa.Array) -> np.ndarray:
    """Vectors of one width as rows of a matrix."""
    flat = (points.combine_chunks() if isinstance(points, pa.ChunkedArray) else points).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(points), -1)


def _binned(points: pa.Array, cuts: Sequence[np.ndarray]) -> np.ndarray:
    cells = _cells(points)
    return np.stack([np.searchsorted(c, cells[:, i]).astype(np.uint8) for i, c in enumerate(cuts)], 1)


def _blobs(cells: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cells))])


def binned(rows: DataFrame, label: str, cuts: Sequence[np.ndarray], *more: str, features: str = "features") -> DataFrame:
    """(id, y, bins, and the columns ``more``) as a written table."""
    plain = rows.select(
        F.monotonically_increasing_id().alias("id"), F.col(label).cast("int").alias("y"), vector_to_array(features).alias("point"), *more
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _blobs(_binned(batch.column("point"), cuts))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], cells, *[batch[c] for c in more]], names=["id", "y", "bins", *more])

    kinds = "".join(f", {c} {plain.schema[c].dataType.simpleString()}" for c in more)
    return materialize(plain.mapInArrow(run, f"id long, y int, bins binary{kinds}"), "bins")


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, classes, bins) of about ``CHUNK`` rows at a time."""

    def joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        cells = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(-1, width)
        return table["id"].to_numpy(), table["y"].to_numpy(), cells

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield joined(held)
            held = []
    if sum(b.num_rows for b in held):
        yield joined(held)


# --- splits ---------------------------------------------------------------------


def times_drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson numbers that depend on (row, tree, seed) alone."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) * 0xD1B54A32D192ED03 + seed & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right").astype(np.uint8)


def walk(cells: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, steps: int = 1 << 30) -> np.ndarray:
    """The nodes that rows reach from the nodes ``at``, after ``steps`` levels at most; a leaf has no left child (0)."""
    at, flat = at.copy(), cells.reshape(-1)
    inner, inputs = left > 0, feature.astype(np.intp)
    child, limit = np.where(inner, left, np.arange(len(left))), np.where(inner, cut, np.uint8(255))  # a leaf leads to itself
    live = np.flatnonzero(inner[at])
    here, first = at[live], live * cells.shape[1]
    while len(live) and steps > 0:
        for _ in range(min(steps, 4)):
            here = child.take(here) + (flat.take(first + inputs.take(here)) > limit.take(here))
        steps -= 4
        at[live] = here
        rest = np.flatnonzero(inner.take(here))
        live, here, first = live[rest], here[rest], first[rest]
    return at


def _counts(values: np.ndarray, y: np.ndarray, times: np.ndarray, place: np.ndarray, nodes: int) -> np.ndarray:
    """Drawn rows by (node, bin, class)."""
    key = (place * BINS + values) * 2 + y
    return np.bincount(key, times, nodes * BINS * 2).reshape(nodes, BINS, 2)


def _purity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a + b * b) / np.maximum(a + b, 1e-300)


def best_cut(counts: np.ndarray, growth: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cut, gain, left counts by class) of each node along one input; the gain is -inf where no cut is allowed."""
    lower = counts.cumsum(1)
    total, lower = lower[:, -1:], lower[:, :-1]
    (l0, l1), (t0, t1) = ((x[..., 0], x[..., 1]) for x in (lower, total))
    u0, u1 = t0 - l0, t1 - l1
    a, b = growth.weights
    gain = _purity(l0 * a, l1 * b) + _purity(u0 * a, u1 * b)
    gain -= _purity(t0 * a, t1 * b)
    least = max(growth.min_leaf, 1)
    gain[(l0 + l1 < least) | (u0 + u1 < least)] = -np.inf
    cut = gain.argmax(1)
    rows = np.arange(len(cut))
    return cut.astype(np.uint8), gain[rows, cut], lower[rows, cut]


def _best_of(looked: np.ndarray, counts: Iterator[np.ndarray], totals: np.ndarray, growth: Growth) -> tuple[np.ndarray, ...]:
    """(feature, cut, gain, left counts) of each node over the inputs it looks at; the gain is 0 where it is a leaf."""
    nodes = len(looked)
    feature, cut = np.zeros(nodes, np.uint8), np.zeros(nodes, np.uint8)
    gain, lower = np.full(nodes, -np.inf), np.zeros((nodes, 2))
    for j, table in enumerate(counts):
        its_cut, its_gain, its_lower = best_cut(table, growth)
        won = its_gain > gain
        feature[won], cut[won], gain[won], lower[won] = looked[won, j], its_cut[won], its_gain[won], its_lower[won]
    floor = 1e-12 * (totals * growth.weights).sum(1)
    return feature, cut, np.where(gain > floor, gain, 0.0), lower


def _open(totals: np.ndarray, level: int, growth: Growth) -> np.ndarray:
    """Whether nodes may be split at all."""
    return (totals > 0).all(1) & (totals.sum(1) >= 2 * growth.min_leaf) & (level < growth.depth)


def _chance(totals: np.ndarray, growth: Growth) -> np.ndarray:
    weighted = totals * growth.weights
    return (weighted[:, 1] / np.maximum(weighted.sum(1), 1e-300)).astype(np.float32)


def finished(cells: np.ndarray, y: np.ndarray, times: np.ndarray, level: int, growth: Growth, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
    """The subtree of some rows whose root is on ``level``: feature, cut, left child, chance of class 1, gain of each node."""
    out: list[tuple[np.ndarray, ...]] = []
    totals = np.bincount(y, times, 2)[None]
    rows, place, made = np.arange(len(y)), np.zeros(len(y), np.int64), 1
    flat, width = cells.reshape(-1), cells.shape[1]
    while len(totals):
        feature, cut = np.zeros(len(totals), np.uint8), np.zeros(len(totals), np.uint8)
        left, gain = np.zeros(len(totals), np.int32), np.zeros(len(totals))
        tried = np.flatnonzero(_open(totals, level, growth))
        number = np.full(len(totals), -1)
        number[tried] = np.arange(len(tried))
        stay = number[place] >= 0
        rows, place = rows[stay], number[place[stay]]
        looked = growth.inputs(draw, len(tried))
        its_y, its_times, first, inputs = y[rows], times[rows], rows * width, looked[place]
        counts = (
            _counts(flat[first + inputs[:, j]], its_y, its_times, place, len(tried)) for j in range(growth.looked_at if len(tried) else 0)
        )
        feature[tried], cut[tried], gain[tried], lower = _best_of(looked, counts, totals[tried], growth)
        split = np.flatnonzero(gain[tried] > 0)
        left[tried[split]] = made + 2 * np.arange(len(split))
        out.append((feature, cut, left, _chance(totals, growth), gain))
        child = np.full(len(tried), -1)
        child[split] = 2 * np.arange(len(split))
        at = tried[place]
        stay = child[place] >= 0
        rows, place, at = rows[stay], child[place[stay]], at[stay]
        place = place + (flat[rows * width + feature[at]] > cut[at])
        totals = np.stack([lower[split], totals[tried[split]] - lower[split]], 1).reshape(-1, 2)
        made += len(totals)
        level += 1
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


# --- growth ---------------------------------------------------------------------


@dataclass
class _Upper:
    """Nodes of all trees that were split by counts over all tasks; the first are the roots, a node's place is its number."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    totals: np.ndarray
    gain: np.ndarray
    tree: np.ndarray
    level: np.ndarray
    dealt: np.ndarray  # nodes whose subtree a group finishes

    def add(self, tree: np.ndarray, level: int, totals: np.ndarray) -> np.ndarray:
        numbers = len(self.tree) + np.arange(len(tree))
        blank = {"feature": 0, "cut": 0, "left": 0, "gain": 0, "dealt": 0, "level": level}
        for name, value in blank.items():
            held = getattr(self, name)
            setattr(self, name, np.concatenate([held, np.full(len(tree), value, held.dtype)]))
        self.tree, self.totals = np.concatenate([self.tree, tree]), np.concatenate([self.totals, totals])
        return numbers

    def parents(self) -> np.ndarray:
        """The node above each node, -1 for roots."""
        out = np.full(len(self.left), -1)
        inner = np.flatnonzero(self.left)
        out[self.left[inner]] = out[self.left[inner] + 1] = inner
        return out

    def within(self) -> np.ndarray:
        """The number of each node among those of its tree, which other trees do not change."""
        order = self.tree.argsort(kind="stable")
        sizes = np.bincount(self.tree)
        out = np.empty(len(order), np.int32)
        out[order] = np.arange(len(order)) - np.repeat(sizes.cumsum() - sizes, sizes)
        return out


def subtree_rows(rows: int) -> int:
    """Rows of a node that one group finishes."""
    return max(SUBTREE_ROWS, min(LARGE_SUBTREE_ROWS, rows // SUBTREES))


def _upper(table: DataFrame, rows: int, growth: Growth) -> _Upper:
    """Split every node of more than :func:`subtree_rows` rows, a job or a few for each level."""
    limit = subtree_rows(rows)
    upper = _Upper(
        *[np.zeros(0, t) for t in (np.uint8, np.uint8, np.int32)], np.zeros((0, 2)), np.zeros(0), *[np.zeros(0, np.int32)] * 2, np.zeros(0, bool)
    )
    roots = upper.add(np.arange(growth.trees, dtype=np.int32), 0, np.full((growth.trees, 2), rows / 2.0))
    frontier = roots if rows > limit else roots[:0]
    upper.dealt[roots] = rows <= limit
    at_once = max(1, COUNT_BYTES // (growth.looked_at * BINS * 2 * 8))  # nodes whose counts a task holds
    level = 0
    while len(frontier):
        trees, nodes = np.unique(upper.tree[frontier], return_counts=True)  # the frontier is in the order of the trees
        draws = [np.random.default_rng([growth.seed, 0, tree, level]) for tree in trees.tolist()]
        looked = np.concatenate([growth.inputs(draw, n) for draw, n in zip(draws, nodes.tolist(), strict=True)])
        some = [slice(i, i + at_once) for i in range(0, len(frontier), at_once)]
        found = [_level(table, upper, frontier[x], looked[x], growth) for x in some]
        feature, cut, gain, lower, totals = (np.concatenate(x) for x in zip(*found, strict=True))
        upper.totals[frontier] = totals
        allowed = _open(totals, level, growth)
        chosen = np.flatnonzero((gain > 0) & allowed)
        parents = frontier[chosen]
        upper.feature[parents], upper.cut[parents], upper.gain[parents] = feature[chosen], cut[chosen], gain[chosen]
        sizes = np.stack([lower[chosen], totals[chosen] - lower[chosen]], 1).reshape(-1, 2)
        children = upper.add(np.repeat(upper.tree[parents], 2), level + 1, sizes)
        upper.left[parents] = children[::2]
        level += 1
        large = sizes.sum(1) > limit
        frontier = children[large & _open(sizes, level, growth)]
        upper.dealt[children] = ~large & _open(sizes, level, growth)
    return upper


def _level(table: DataFrame, upper: _Upper, frontier: np.ndarray, looked: np.ndarray, growth: Growth) -> tuple[np.ndarray, ...]:
    """(feature, cut, gain, left counts, counts by class) of the frontier's nodes, from one pass over the rows."""
    feature, cut, left, width = upper.feature, upper.cut, upper.left, growth.width
    number = np.full(len(left), -1)
    number[frontier] = np.arange(len(frontier))
    trees = np.unique(upper.tree[frontier])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(frontier), growth.looked_at, BINS, 2))
        for ids, y, cells in _chunks(batches, width):
            flat = cells.reshape(-1)
            for tree in trees.tolist():
                times = times_drawn(ids, tree, growth.seed)
                used = np.flatnonzero(times)
                place = number[walk(cells[used], np.full(len(used), tree), feature, cut, left)]
                used, place = used[place >= 0], place[place >= 0]
                if len(used):
                    first = place.min()
                    nodes = place.max() - first + 1  # a tree's nodes are neighbours
                    its_y, its_times, at, inputs = y[used], times[used].astype(float), used * width, looked[place]
                    for j in range(growth.looked_at):
                        sums[first : first + nodes, j] += _counts(flat[at + inputs[:, j]], its_y, its_times, place - first, nodes)
        yield pa.RecordBatch.from_pydict({"node": pa.array(range(len(frontier)), pa.int32()), "counts": [x.tobytes() for x in sums]})

    def choose(part: pa.Table) -> pa.Table:
        node = part["node"][0].as_py()
        sums = sum(np.frombuffer(x, np.float64) for x in part["counts"].to_pylist()).reshape(growth.looked_at, BINS, 2)
        totals = sums[0].sum(0)[None]
        its_feature, its_cut, gain, lower = _best_of(looked[node : node + 1], (x[None] for x in sums), totals, growth)
        row = {"node": node, "feature": int(its_feature[0]), "cut": int(its_cut[0]), "gain": float(gain[0])}
        row |= {"l0": lower[0, 0], "l1": lower[0, 1], "n0": totals[0, 0], "n1": totals[0, 1]}
        return pa.Table.from_pylist([row], pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), *[(c, pa.float64()) for c in ("gain", "l0", "l1", "n0", "n1")]]))

    counted = table.mapInArrow(count, "node int, counts binary").groupBy("node")
    found = counted.applyInArrow(choose, "node int, feature int, cut int, gain double, l0 double, l1 double, n0 double, n1 double").toArrow()
    found = found.sort_by("node")  # a row for each node of the frontier
    column = {c: found[c].to_numpy() for c in found.column_names}
    return (
        column["feature"].astype(np.uint8), column["cut"].astype(np.uint8), column["gain"],
        np.stack([column["l0"], column["l1"]], 1), np.stack([column["n0"], column["n1"]], 1),
    )


def _trees_at_once(rows: int, width: int, most: int) -> int:
    """Trees to which rows of so many bytes are dealt at a time."""
    return max(1, min(most, DEALT_BYTES // max(1, rows * width)))


def _part(tree: int, node: int, nodes: Sequence[np.ndarray], above: np.ndarray, width: int) -> pa.Table:
    """A row of ``_PARTS``."""
    feature, cut, left, chance, gain = nodes
    columns = {"above": above, "feature": feature, "cut": cut, "left": left, "chance": chance, "gains": np.bincount(feature, gain, width)}
    return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in columns.items()}})


def grow(table: DataFrame, growth: Growth) -> DataFrame:
    """The trees of a forest of binned rows as a written table.

    One row for each tree; with more than ``WHOLE_ROWS`` rows one for each part of a tree.
    """
    rows = table.count()
    upper = _upper(table, rows, growth)
    width, within = growth.width, upper.within()
    in_parts = rows > WHOLE_ROWS
    chances, parent = _chance(upper.totals, growth), upper.parents()

    def deal(trees: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, y, cells in _chunks(batches, width):
                for tree in trees:
                    times = times_drawn(ids, tree, growth.seed)
                    used = np.flatnonzero(times)
                    node = walk(cells[used], np.full(len(used), tree), upper.feature, upper.cut, upper.left)
                    kept = np.flatnonzero(upper.dealt[node])
                    kept = kept[node[kept].argsort(kind="stable")]
                    used, node = used[kept], node[kept]
                    packed = np.concatenate([cells[used], y[used, None].astype(np.uint8), times[used, None]], 1)
                    nodes, starts = np.unique(node, return_index=True)
                    blobs = [x.tobytes() for x in np.split(packed, starts[1:])] if len(nodes) else []
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([tree] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int32()), "packed": pa.array(blobs, pa.binary())})

        return run

    def finish(part: pa.Table) -> pa.Table:
        tree, node = part["tree"][0].as_py(), part["node"][0].as_py()
        packed = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, width + 2) for x in part["packed"].to_pylist()])
        draw = np.random.default_rng([growth.seed, 1, tree, int(within[node])])
        cells, y, times = np.ascontiguousarray(packed[:, :width]), packed[:, width].astype(np.int64), packed[:, width + 1].astype(float)
        nodes = finished(cells, y, times, int(upper.level[node]), growth, draw)
        if in_parts:
            way = [node]
            while parent[way[-1]] >= 0:
                way.append(int(parent[way[-1]]))
            return _part(tree, int(within[node]), nodes, chances[way[:0:-1]], width)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("feature", "cut", "left", "chance", "gain"), nodes, strict=True)}})

    def whole(key: tuple, part: pa.Table) -> pa.Table:
        """One tree: its upper nodes, each dealt node replaced by its subtree."""
        tree = key[0].as_py()
        own = np.flatnonzero(upper.tree == tree)
        left = np.where(upper.left[own] > 0, within[upper.left[own]], 0).astype(np.int32)
        top = [upper.feature[own], upper.cut[own], left, _chance(upper.totals[own], growth), upper.gain[own]]
        parts, made = [top], len(own)
        for row in part.sort_by("node").to_pylist():
            kinds = {"feature": np.uint8, "cut": np.uint8, "left": np.int32, "chance": np.float32, "gain": np.float64}
            nodes = [np.frombuffer(row[n], t).copy() for n, t in kinds.items()]
            nodes[2][nodes[2] > 0] += made - 1
            for mine, its in zip(top, nodes, strict=True):
                mine[within[row["node"]]] = its[0]
            parts.append([x[1:] for x in nodes])
            made += len(nodes[0]) - 1
        feature, cut, left, chance, gain = (np.concatenate(x) for x in zip(*parts, strict=True))
        gains = np.bincount(feature, gain, width)
        columns = {"feature": feature, "cut": cut, "left": left, "chance": chance, "gains": gains}
        return pa.table({"tree": pa.array([tree], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in columns.items()}})

    spark = table.sparkSession
    if in_parts:
        tops = []
        for tree in range(growth.trees):
            own = np.flatnonzero(upper.tree == tree)
            left = np.where(upper.left[own] > 0, within[upper.left[own]], np.where(upper.dealt[own], 0, -1)).astype(np.int32)
            tops.append(_part(tree, -1, (upper.feature[own], upper.cut[own], left, chances[own], upper.gain[own]), chances[:0], width))
        parts = [materialize(spark.createDataFrame(pa.concat_tables(tops), _PARTS), "parts")]
        at_once = _trees_at_once(rows, width + 2, DEALT_TREES)
        for start in range(0, growth.trees, at_once):
            dealt = table.mapInArrow(deal(range(start, min(start + at_once, growth.trees))), "tree int, node int, packed binary")
            parts.append(materialize(dealt.groupBy("tree", "node").applyInArrow(finish, _PARTS), "parts"))
            release_shuffles(spark)
        return reduce(DataFrame.unionAll, parts)

    bare = spark.createDataFrame([(int(t), -1) for t in range(growth.trees)], "tree int, node int")  # a tree may have no dealt node
    nodes = "feature binary, cut binary, left binary, chance binary, gain binary"
    parts = []
    for start in range(0, growth.trees, DEALT_TREES):
        trees = range(start, min(start + DEALT_TREES, growth.trees))
        dealt = table.mapInArrow(deal(trees), "tree int, node int, packed binary")
        parts.append(materialize(dealt.groupBy("tree", "node").applyInArrow(finish, f"tree int, node int, {nodes}"), "subtrees"))
    subtrees = parts[0]
    for part in parts[1:]:
        subtrees = subtrees.unionByName(part)

    def joined(key: tuple, _: pa.Table, part: pa.Table) -> pa.Table:
        return whole(key, part)

    return materialize(bare.groupBy("tree").cogroup(subtrees.groupBy("tree")).applyInArrow(joined, _TREES), "trees")


# --- the model ------------------------------------------------------------------


def _sent(trees: DataFrame) -> list[Broadcast]:
    """The trees by number, some at a time through the driver, as broadcasts of (feature, cut, left, chance)."""
    spark, out = trees.sparkSession, []
    count = trees.agg(F.max("tree")).first()[0] + 1
    for start in range(0, count, SENT_TREES):
        found = trees.where(F.col("tree").between(start, start + SENT_TREES - 1)).drop("gains").orderBy("tree").toArrow().to_pylist()
        kinds = {"feature": np.uint8, "cut": np.uint8, "left": np.int32, "chance": np.float32}
        out.append(spark.sparkContext.broadcast([tuple(np.frombuffer(r[n], t) for n, t in kinds.items()) for r in found]))
    return out


def recalls(rows: DataFrame, trees: DataFrame, width: int, sizes: Sequence[int], depths: Sequence[int]) -> dict[tuple[int, int], float]:
    """The recall of class 1 on binned rows by (trees, depth): the first trees of the forest, cut off at the depth.

    A tree of less depth is the upper part of the deeper one, as its nodes look at the same inputs.
    """
    if "node" in trees.columns:
        return _recalls_of_parts(rows.where("y = 1"), trees, width, sizes, depths)
    sent = _sent(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, cells in _chunks(batches, width):
            cells = cells[y == 1]
            votes, out, seen = {d: np.zeros(len(cells)) for d in depths}, [], 0
            for feature, cut, left, chance in (t for block in sent for t in block.value):
                at, level = np.zeros(len(cells), np.int64), 0
                for d in sorted(depths):
                    at, level = walk(cells, at, feature, cut, left, d - level), d
                    votes[d] += chance[at]
                seen += 1
                out += [{"trees": seen, "depth": d, "found": int((votes[d] > seen / 2).sum()), "n": len(cells)} for d in depths if seen in sizes]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("trees", pa.int32()), ("depth", pa.int32()), ("found", pa.int64()), ("n", pa.int64())]))

    counted = rows.mapInArrow(run, "trees int, depth int, found long, n long").groupBy("trees", "depth")
    found = {(r["trees"], r["depth"]): r for r in counted.agg(F.sum("found").alias("found"), F.sum("n").alias("n")).collect()}
    for block in sent:
        block.unpersist()
    return {k: r["found"] / r["n"] if r["n"] else 0.0 for k, r in found.items()}


def _recalls_of_parts(ones: DataFrame, trees: DataFrame, width: int, sizes: Sequence[int], depths: Sequence[int]) -> dict[tuple[int, int], float]:
    n, sums, out = ones.count(), [], {}
    for start, size in zip([0, *sorted(sizes)], sorted(sizes), strict=False):
        sums += _sums_of_parts(ones, trees, width, range(start, size), depths)

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for votes in batch.column("sums").to_pylist():
                    found = (np.frombuffer(votes).reshape(-1, len(depths)) > size / 2).sum(0)
                    yield pa.RecordBatch.from_pydict({"depth": pa.array(depths, pa.int32()), "found": pa.array(found, pa.int64())})

        counted = _added(sums).mapInArrow(hits, "depth int, found long").groupBy("depth").agg(F.sum("found").alias("found"))
        found = {r["depth"]: r["found"] for r in counted.collect()}
        out |= {(size, d): found[d] / n if n else 0.0 for d in depths}
    return out


def _at_depths(cells: np.ndarray, nodes: Sequence[np.ndarray], depths: Sequence[int]) -> np.ndarray:
    """The chances at the nodes where rows are after each number of levels, rows x depths."""
    feature, cut, left, chance = nodes
    out, at, level = np.zeros((len(cells), len(depths))), np.zeros(len(cells), np.int64), 0
    for i in np.argsort(depths):
        at, level = walk(cells, at, feature, cut, left, depths[i] - level), depths[i]
        out[:, i] = chance[at]
    return out


def _by_slice(ids: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, places) of ids."""
    own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slices)
    order = own.argsort(kind="stable")
    numbers, starts = np.unique(own[order], return_index=True)
    yield from zip(numbers.tolist(), np.split(order, starts[1:]) if len(numbers) else [], strict=True)


_SUMS = "slice int, batch int, ids binary, sums binary"


def _sums_of_parts(rows: DataFrame, trees: DataFrame, width: int, numbers: range, depths: Sequence[int]) -> list[DataFrame]:
    """Written tables of (slice, batch, ids, sums over a batch of trees of the chances at each depth) for rows of (id, bins).

    A row walks the upper nodes of a tree, which are sent to all tasks, and goes on to the part below. Slices have about
    ``CHUNK`` rows.
    """
    count = rows.count()
    slices = max(1, -(-count // CHUNK))
    plain = rows.select("id", F.lit(0).alias("y"), "bins")
    below = trees.where("node >= 0")
    in_a_tree = below.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    pieces = max(1, -(-count // (in_a_tree * LARGE_SUBTREE_ROWS)))  # of the rows that go to one part
    at_once, out = _trees_at_once(count, width + 8, SENT_TREES), []
    for start in range(numbers.start, numbers.stop, at_once):
        batch = range(start, min(start + at_once, numbers.stop))
        its = F.col("tree").between(batch.start, batch.stop - 1)
        tops = {r["tree"]: [np.frombuffer(r[n], t) for n, t in _KINDS.items()] for r in trees.where("node = -1").where(its).collect()}

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, _, cells in _chunks(batches, width):
                for tree, nodes in tops.items():
                    feature, cut, left, _ = nodes
                    at = walk(cells, np.zeros(len(ids), np.int64), feature, cut, left)
                    shut, rest = np.flatnonzero(left[at] < 0), np.flatnonzero(left[at] == 0)
                    votes = _at_depths(cells[shut], nodes, depths)
                    found = [(-1, s, ids[shut[x]], b"", votes[x].tobytes()) for s, x in _by_slice(ids[shut], slices)]
                    for piece, x in _by_slice(ids[rest], pieces):
                        x = rest[x]
                        x = x[at[x].argsort(kind="stable")]
                        ends, starts = np.unique(at[x], return_index=True)
                        found += [(int(e), piece, ids[i], cells[i].tobytes(), b"") for e, i in zip(ends, np.split(x, starts[1:]), strict=True)]
                    kinds = {"node": pa.int32(), "piece": pa.int32(), "ids": pa.binary(), "cells": pa.binary(), "sums": pa.binary()}
                    columns = zip(*((e, p, i.tobytes(), c, v) for e, p, i, c, v in found), strict=True)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([tree] * len(found), pa.int32()), **{n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)}})

        def vote(key: tuple, part: pa.Table, its: pa.Table) -> pa.Table:
            ids = np.frombuffer(b"".join(part["ids"].to_pylist()), np.int64)
            if its.num_rows:
                row = its.to_pylist()[0]
                nodes, above = [np.frombuffer(row[n], t) for n, t in _KINDS.items()], np.frombuffer(row["above"], np.float32)
                cells = np.frombuffer(b"".join(part["cells"].to_pylist()), np.uint8).reshape(-1, width)
                votes = _at_depths(cells, nodes, [max(d - len(above), 0) for d in depths])
                for i, d in enumerate(depths):
                    if d < len(above):
                        votes[:, i] = above[d]
            else:
                votes = np.frombuffer(b"".join(part["sums"].to_pylist())).reshape(-1, len(depths))
            found = list(_by_slice(ids, slices))
            return pa.table({
                "slice": pa.array([s for s, _ in found], pa.int32()), "tree": pa.array([key[0].as_py()] * len(found), pa.int32()),
                "ids": pa.array([ids[x].tobytes() for _, x in found], pa.binary()), "sums": pa.array([votes[x].tobytes() for _, x in found], pa.binary()),
            })

        def add(part: pa.Table) -> pa.Table:
            ids = [np.frombuffer(x, np.int64) for x in part["ids"].to_pylist()]
            tree = np.repeat(part["tree"].to_numpy(), list(map(len, ids)))
            ids, votes = np.concatenate(ids), np.frombuffer(b"".join(part["sums"].to_pylist())).reshape(-1, len(depths))
            order = np.lexsort((tree, ids))  # a row has one vote of each tree
            sums = votes[order].reshape(-1, len(batch), len(depths)).sum(1)
            return _sums_row(part["slice"][0].as_py(), batch.start, ids[order[:: len(batch)]], sums)

        sent = plain.mapInArrow(send, "tree int, node int, piece int, ids binary, cells binary, sums binary")
        met = below.where(its).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        keys = ["tree", "node", "piece"]
        votes = sent.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(vote, "slice int, tree int, ids binary, sums binary")
        out.append(materialize(votes.groupBy("slice").applyInArrow(add, _SUMS), "votes"))
        release_shuffles(rows.sparkSession)
    return out


def _sums_row(number: int, batch: int, ids: np.ndarray, sums: np.ndarray) -> pa.Table:
    return pa.table({"slice": pa.array([number], pa.int32()), "batch": pa.array([batch], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})


def _added(tables: Sequence[DataFrame]) -> DataFrame:
    """The sums of all batches of trees, a row for each slice."""

    def add(part: pa.Table) -> pa.Table:
        part = part.sort_by("batch")  # ids of a slice are in the same order in all batches
        ids = np.frombuffer(part["ids"][0].as_py(), np.int64)
        return _sums_row(part["slice"][0].as_py(), 0, ids, sum(np.frombuffer(x) for x in part["sums"].to_pylist()))

    return reduce(DataFrame.unionAll, tables).groupBy("slice").applyInArrow(add, _SUMS)


def _chances_of_parts(rows: DataFrame, trees: DataFrame, width: int) -> DataFrame:
    count = trees.agg(F.max("tree")).first()[0] + 1
    sums = _added(_sums_of_parts(rows, trees, width, range(count), [1 << 30]))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, votes in zip(batch.column("ids").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"id": np.frombuffer(ids, np.int64), "chance": np.frombuffer(votes) / count})

    return sums.mapInArrow(mean, "id long, chance double")


def _chances(rows: DataFrame, trees: DataFrame, width: int) -> DataFrame:
    """(id, chance): the mean over the trees of the chance of class 1, for rows of (id, bins).

    Slices of about ``CHUNK`` rows meet ``SENT_TREES`` trees at a time in the tasks, so neither the driver nor a task
    holds all trees or all rows.
    """
    if "node" in trees.columns:
        return _chances_of_parts(rows, trees, width)
    count, last = rows.count(), trees.agg(F.max("tree")).first()[0]
    slices, blocks = max(1, -(-count // CHUNK)), last // SENT_TREES + 1
    sliced = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "bins"
    )
    met = trees.select(
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.floor(F.col("tree") / SENT_TREES).cast("int").alias("block"), *[c for c in trees.columns if c != "gains"]
    )

    def vote(key: tuple, part: pa.Table, its: pa.Table) -> pa.Table:
        part = part.sort_by("id")  # the same order in all blocks
        cells = np.frombuffer(b"".join(part["bins"].to_pylist()), np.uint8).reshape(-1, width)
        total, kinds = np.zeros(len(cells)), {"feature": np.uint8, "cut": np.uint8, "left": np.int32, "chance": np.float32}
        for row in its.sort_by("tree").to_pylist():
            feature, cut, left, chance = (np.frombuffer(row[n], t) for n, t in kinds.items())
            total += chance[walk(cells, np.zeros(len(cells), np.int64), feature, cut, left)]
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([part["id"].to_numpy().tobytes()], pa.binary()), "sums": pa.array([total.tobytes()], pa.binary())})

    def mean(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        total = sum(np.frombuffer(x) for x in part["sums"].to_pylist())
        return pa.table({"id": np.frombuffer(part["ids"][0].as_py(), np.int64), "chance": total / (last + 1)})

    votes = sliced.groupBy("slice", "block").cogroup(met.groupBy("slice", "block")).applyInArrow(vote, "slice int, block int, ids binary, sums binary")
    return votes.groupBy("slice").applyInArrow(mean, "id long, chance double")


class TreeTableModel(Model, MLWritable, MLReadable):
    """A fitted forest whose trees lie in a table; scores vectors as Spark ML's forest does."""

    def __init__(self, trees: DataFrame, cuts: Sequence[np.ndarray], features: str = "features"):
        super().__init__()
        self.trees, self.cuts, self.features = trees, list(cuts), features

    @property
    def featureImportances(self) -> DenseVector:
        """Mean over the trees of each tree's share of gains by input."""

        def whole(part: pa.Table) -> pa.Table:
            gains = sum(np.frombuffer(x) for x in part.sort_by(order)["gains"].to_pylist())
            return pa.table({"tree": part["tree"][:1], "gains": pa.array([gains.tobytes()], pa.binary())})

        order = [(c, "ascending") for c in ("tree", "node") if c in self.trees.columns]
        parts = self.trees.select(*[c for c, _ in order], "gains")
        gains = parts.groupBy("tree").applyInArrow(whole, "tree int, gains binary").orderBy("tree")
        rows = [np.frombuffer(r["gains"]) for r in gains.collect()]  # one for each tree
        shares = sum((g / g.sum() if g.sum() > 0 else g) for g in rows)
        return DenseVector(shares / shares.sum() if shares.sum() > 0 else shares)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts, key, cells = self.cuts, f"{self.uid}__id", f"{self.uid}__bins"

        @F.arrow_udf("binary")
        def bins(points: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in points:
                yield _blobs(_binned(batch, cuts))

        # written once: what is numbered and scored are the rows that are joined
        rows = materialize(dataset.withColumns({key: F.monotonically_increasing_id(), cells: bins(vector_to_array(self.features))}), "scored-rows")
        chances = materialize(_chances(rows.select(F.col(key).alias("id"), F.col(cells).alias("bins")), self.trees, len(cuts)), "chances")
        scored = rows.join(chances.withColumnRenamed("id", key), key)
        p = F.col("chance")
        more = {"probability": array_to_vector(F.array(F.lit(1.0) - p, p)), "prediction": (p > 0.5).cast("double")}
        return scored.select(*dataset.columns, *[c.alias(n) for n, c in more.items()])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TreeTableModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        more = {"cuts": [c.tolist() for c in self.model.cuts], "features": self.model.features, "parts": "node" in self.model.trees.columns}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, more)
        self.model.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> TreeTableModel:
        spark: SparkSession = self.sparkSession
        facts = DefaultParamsReader.loadMetadata(path, spark)
        cuts = [np.array(c, float) for c in facts["cuts"]]
        trees = spark.read.schema(_PARTS if facts.get("parts") else _TREES).parquet(f"{path}/trees")
        model = TreeTableModel(trees, cuts, facts["features"])
        return model._resetUid(facts["uid"])
