"""Regression trees as tables of nodes: forests and second-order boosting, grown level by level.

Features are cut into bins, and rows are kept as blocks: one byte a feature and row, the target, and for forests one byte a
tree and row. A level of open nodes is one job: each block gives, for every node, feature and bin, the sums
of gradients and of hessians of its rows (for squared errors: residuals and weights), and these add up. The best split of a
node is the cut whose two sides gain most, with an L2 penalty on the leaf values. Of two children only the one of less weight is
counted, the other is what is left of the parent. What leaves the executors has the size of the
model, never of the rows. A node of a forest whose rows fit a task (``SUBTREE_ROWS``) leaves the frontier: its rows meet in one
task, which grows the rest of the subtree in memory, however deep. Over at most ``TASK_ROWS`` rows one task does all rounds of
boosting, because a job for each level takes longer than the level. All ways follow the same formulas and give the same trees.
Where many rows come to a node, features are counted together by their joint bins, and the sums of each come from those.

Targets and residuals count in whole steps of a power of two, so sums are exact: with the same cuts, the same rows in any layout
and on any number of tasks give the same model, and so does a repeated task. Ties go to the lower feature, then to the lower cut.

A model is a table of nodes. ``TreeModel.score`` walks all trees in step over Arrow batches; another engine can walk the table
by joins, a level at a time.
"""

import gc
import hashlib
import math
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.runtime import pinned

# Workers get what they run from here with the task; they need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows up to which one task does all rounds of boosting.
TASK_ROWS = 1 << 20
#: Weight up to which the rows of a node of a forest are worked on by one task; they take about 20 bytes each.
SUBTREE_ROWS = 1 << 20
#: Rows of a block.
BLOCK_ROWS = 1 << 18
#: Rows that are sent to such tasks at a time, if that is more than eight times the table.
SENT_ROWS = 1 << 24
#: Nodes that a task or job counts at once, and nodes whose splits are judged at once.
TOGETHER, JUDGED = 1 << 11, 1 << 8
#: Nodes of a level up to which each is worked on by the positions of its rows.
APART = 1 << 6
#: Joint bins of features that are counted together, where so many rows come to a node.
PAIRED = 1 << 12
#: Gains up to this size are rounding.
LEAST_GAIN = 1e-6
#: Rounds of boosting between two checkpoints.
PINNED_EVERY = 10
#: Ranks of the sketch that proposes cuts are off by at most one in so many; columns of half as many rows are exact.
ACCURACY = 100_000
#: Upper bounds of the Poisson distribution of mean 1: how often a bootstrap sample takes a row.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
           0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020]


@dataclass
class Nodes:
    """A growing table of nodes, by columns. A leaf has feature -1; the right child follows the left one."""

    tree: array = field(default_factory=lambda: array("q"))
    feature: array = field(default_factory=lambda: array("q"))
    cut: array = field(default_factory=lambda: array("q"))
    threshold: array = field(default_factory=lambda: array("d"))
    left: array = field(default_factory=lambda: array("q"))
    value: array = field(default_factory=lambda: array("d"))
    weight: array = field(default_factory=lambda: array("q"))
    gain: array = field(default_factory=lambda: array("d"))

    def add(self, tree: int, value: float, weight: int) -> int:
        for column, x in zip(vars(self).values(), (tree, -1, 0, 0.0, 0, value, weight, 0.0)):
            column.append(x)
        return len(self.tree) - 1

    def extend(self, tree: int, value: np.ndarray, weight: np.ndarray) -> None:
        """Many leaves of a tree."""
        n = len(value)
        zero, none = np.zeros(n, np.int64), np.zeros(n)
        for column, x in zip(vars(self).values(), (zero + tree, zero - 1, zero, none, zero, value, weight, none)):
            column.frombytes(np.ascontiguousarray(x, np.int64 if column.typecode == "q" else np.float64).tobytes())


@dataclass
class TreeModel:
    """Trees over the features ``order``: ``base`` plus the sum (or for forests, the mean) of the leaf values."""

    order: list[str]
    base: float
    mean: bool
    roots: list[int]
    nodes: Nodes

    @property
    def depth(self) -> int:
        level = np.zeros(len(self.nodes.tree), np.int64)
        for i, (f, left) in enumerate(zip(self.nodes.feature, self.nodes.left)):
            if f >= 0:  # children come after their parent
                level[left] = level[left + 1] = level[i] + 1
        return int(level.max(initial=0))

    def score(self, features: list[Column], where: Column | None = None) -> Column:
        """Prediction for the features in order, as doubles; null where ``where`` is given and not true."""
        spark = SparkSession.active()
        sent = spark.sparkContext.broadcast((
            np.array(self.roots), np.array(self.nodes.feature, np.int16), np.array(self.nodes.threshold),
            np.array(self.nodes.left, np.int32), np.array(self.nodes.value)))
        base, mean, size, given = self.base, self.mean, len(features), where is not None

        def predicted(*columns: pd.Series) -> pd.Series:
            roots, feature, threshold, left, value = sent.value
            x = np.column_stack([c.to_numpy(np.float64) for c in columns[:size]])
            asked = slice(None) if not given else np.flatnonzero(columns[-1].fillna(False).to_numpy(bool))
            rows, scores = x[asked], np.full(len(x), np.nan)
            out = [_walked(rows[at:at + 4096], roots, feature, threshold, left, value) for at in range(0, len(rows), 4096)]
            total = base + np.concatenate(out) if out else np.empty(0)
            scores[asked] = total / len(roots) if mean else total
            return pd.Series(scores)

        return F.pandas_udf(predicted, "double")(*features, *([where] if given else []))

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        missing = F.raise_error(F.lit("a feature is missing")).cast("double")
        return df.withColumn(name, self.score([F.coalesce(F.col(f).cast("double"), missing) for f in self.order]))

    def importances(self) -> np.ndarray:
        """Gain by feature, each tree and then all together scaled to 1."""
        tree, feature = np.array(self.nodes.tree), np.array(self.nodes.feature)
        split = feature >= 0
        gains = np.zeros((len(self.roots), len(self.order)))
        np.add.at(gains, (tree[split], feature[split]), np.array(self.nodes.gain)[split])
        total = gains.sum(1, keepdims=True)
        shares = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(0)
        return shares / shares.sum() if shares.sum() else shares

    def table(self, spark: SparkSession, first: int = 0, last: int | None = None) -> DataFrame:
        """The nodes, or those from ``first`` on before ``last``: id, tree, feature, cut, threshold, left, value, weight, gain."""
        return self._rows(spark, self._sent(spark), first, last)

    def _sent(self, spark: SparkSession) -> Broadcast:
        return spark.sparkContext.broadcast([np.asarray(column) for column in vars(self.nodes).values()])

    def _rows(self, spark: SparkSession, sent: Broadcast, first: int, last: int | None) -> DataFrame:
        kinds = {f.name: "double" if f.name in ("threshold", "value", "gain") else "long" for f in fields(Nodes)}

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[at]) for x in sent.value]], names=["id", *kinds])

        return spark.range(*slice(first, last).indices(len(self.nodes.tree))).mapInArrow(
            rows, ", ".join(f"{name} {kind}" for name, kind in {"id": "long", **kinds}.items()))

    def save(self, spark: SparkSession, path: str) -> None:
        sent = self._sent(spark)
        self._rows(spark, sent, 0, None).write.mode("overwrite").parquet(f"{path}/nodes")
        sent.destroy()
        row = [(self.order, self.base, self.mean, self.roots)]
        spark.createDataFrame(row, "features array<string>, base double, mean boolean, roots array<int>").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TreeModel":
        about = spark.read.parquet(f"{path}/model").first()
        rows = spark.read.parquet(f"{path}/nodes").toArrow()
        order = np.argsort(rows["id"].to_numpy())
        nodes = Nodes(**{name: array(column.typecode, rows[name].to_numpy()[order].tobytes())
                         for name, column in vars(Nodes()).items()})
        return cls(list(about["features"]), about["base"], about["mean"], list(about["roots"]), nodes)


def _walked(x: np.ndarray, roots, feature, threshold, left, value) -> np.ndarray:
    """Sum of the leaf values that each row reaches, tree after tree in order."""
    rows, flat, total = np.arange(len(x)), np.ascontiguousarray(x.T).ravel(), np.zeros(len(x))
    for root in roots:
        at = np.full(len(x), root, np.int64)
        split = feature[at]
        while (inner := split >= 0).any():
            # NaN is above all, as in its bin.
            right = ~(flat[np.maximum(split, 0).astype(np.int64) * len(x) + rows] <= threshold[at])
            at = np.where(inner, left[at] + right, at)
            split = feature[at]
        total += value[at]
    return total


def walked(bins: np.ndarray, start: int, steps: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node that each row (a column of ``bins``) reaches from ``start`` in so many steps down."""
    rows, leaf = bins.shape[1], feature < 0
    kind = np.int32 if max(bins.size, len(feature)) < 1 << 31 else np.int64
    # A leaf leads to itself: no bin is above its cut.
    line = np.where(leaf, 0, feature * rows).astype(kind)
    cut = np.where(leaf, np.iinfo(bins.dtype).max, cut).astype(bins.dtype)
    left = np.where(leaf, np.arange(len(feature)), left).astype(kind)
    at, row, flat = np.full(rows, start, kind), np.arange(rows, dtype=kind), bins.ravel()
    for _ in range(steps):
        right = flat.take(line.take(at) + row) > cut.take(at)
        at = left.take(at) + right
    return at


# --- rows --------------------------------------------------------------------------------------


def find_cuts(rows: DataFrame, order: list[str], bins: int) -> list[list[float]]:
    """Ascending cuts of each feature: the values at ``bins`` - 1 evenly spaced ranks, from one pass of sketches.

    A feature is a group, so the sketches of different features are merged by different tasks.
    """
    shares = [k / bins for k in range(1, bins)]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), (F.col(c).cast("double") + 0.0).alias("x")) for i, c in enumerate(order)])
    sketches = rows.select(F.explode(cells).alias("cell")).groupBy("cell.i").agg(
        F.percentile_approx("cell.x", shares, ACCURACY).alias("cuts"))
    found = {r["i"]: r["cuts"] or [] for r in sketches.collect()}
    return [sorted({x for x in found.get(i, []) if x == x}) for i in range(len(order))]


def power_step(rows: DataFrame, target: str) -> float:
    """Steps per unit of the target: 2^16, or fewer if sums over all rows could leave 61 bits."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(target))).alias("m")).first()
    if not found["n"]:
        raise ValueError("no rows to fit")
    room = 2.0 ** 61 / max(1.0, found["n"] * 16 * (found["m"] or 0.0))
    return float(2.0 ** min(16, int(np.floor(np.log2(room)))))


def in_steps(x: Column, steps: float) -> Column:
    return F.floor(x * steps + 0.5).cast("long")


def md5_starts(words: list) -> np.ndarray:
    """The first 64 bits of the MD5 digest of many texts of one block each; its 16 words are numbers or arrays (all rows at once)."""
    state = [np.full(max(map(np.size, words)), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            mixed, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, k = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += np.uint32(int(abs(math.sin(i + 1)) * 2.0 ** 32))
        mixed += words[k]
        turn = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4]
        high = mixed << np.uint32(turn)
        mixed >>= np.uint32(32 - turn)
        mixed |= high
        mixed += b
        a, b, c, d = d, mixed, b, c
    return (a + state[0]).byteswap().astype(np.uint64) << np.uint64(32) | (b + state[1]).byteswap()


def _blocks_of_words(keys: list[bytes], start: int) -> list:
    """MD5's words of one block for texts of ``start`` bytes (0 here) and a key; a word that is 0 everywhere is a number."""
    size = np.array([start + len(k) for k in keys])
    block = np.zeros((len(keys), 64), np.uint8)
    own = np.array(keys, "S")
    block[:, start:start + own.itemsize] = own.view(np.uint8).reshape(len(keys), -1)
    block[np.arange(len(keys)), size] = 0x80
    block[:, 56:58] = (8 * size).astype("<u2").view(np.uint8).reshape(-1, 2)
    words = np.ascontiguousarray(block.view("<u4").T)
    return [w if w.any() else np.uint32(0) for w in words]


def draws(keys: list[str | None], trees: int, seed: int) -> np.ndarray:
    """How often each tree's bootstrap sample takes each row: ``uniform(tree:key, bag)`` among ``POISSON``; never without a key."""
    bounds = np.ceil(np.array(POISSON) * 2.0 ** 52).astype(np.uint64)
    ends, known = [(k or "").encode() for k in keys], np.array([k is not None for k in keys], bool)
    out = np.empty((trees, len(keys)), np.uint8)
    short, words = False, {}
    for t in range(trees):
        start = f"bag{seed}:{t}:".encode()
        if len(start) not in words:
            # What is longer than one block of MD5 goes to the library.
            short = len(start) + max(map(len, ends), default=64) < 56
            words[len(start)] = _blocks_of_words(ends, len(start)) if short else []
        if short:
            first = np.frombuffer(start + bytes(-len(start) % 4), "<u4")
            whole = words[len(start)]
            found = md5_starts([w | x for w, x in zip(whole, first)] + whole[len(first):])
        else:
            found = np.frombuffer(
                b"".join([hashlib.md5(start + k, usedforsecurity=False).digest()[:8] for k in ends]), ">u8").astype(np.uint64)
        out[t] = np.searchsorted(bounds, found >> np.uint64(12), "right")
    return out * known


#: Bins (features x rows), the target in steps, and the draws (trees x rows) or none.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def in_blocks(clean: DataFrame, order: list[str], target: str, cuts: list[list[float]], steps: float, rows: int,
              one_task: bool, trees: int = 0, seed: int = 0) -> RDD:
    """``clean`` as blocks of rows, written once to reliable storage."""
    kind = np.min_scalar_type(max(map(len, cuts)))
    edges = [np.array(c) for c in cuts]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.empty((len(order), batch.num_rows), kind)
            for i, edge in enumerate(edges):
                # NaN is above all cuts, a missing value below.
                x = batch.column(i)
                bins[i] = np.searchsorted(edge, x.to_numpy(zero_copy_only=False), "left")
                if x.null_count:
                    bins[i][x.is_null().to_numpy(zero_copy_only=False)] = 0
            if batch.column(len(order)).null_count:
                raise ValueError("a target is missing")
            y = batch.column(len(order)).to_numpy(zero_copy_only=False)
            keys = batch.column(len(order) + 1).to_pylist() if trees else []
            parts = [bins.tobytes(), y.tobytes(), draws(keys, trees, seed).tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]],
                names=["n", "bins", "y", "drawn"])

    def joined(packed) -> Iterator[Block]:
        held, size = [], 0
        for n, *parts in packed:
            bins, y, drawn = (np.frombuffer(p, k) for p, k in zip(parts, (kind, np.int64, np.uint8)))
            held.append((bins.reshape(-1, n), y, drawn.reshape(-1, n)))
            size += n
            if size >= BLOCK_ROWS and not one_task:
                yield tuple(np.concatenate(x, axis=-1) for x in zip(*held))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(x, axis=-1) for x in zip(*held))

    tasks = 1 if one_task else max(clean.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS))
    packed = clean.repartition(tasks).mapInArrow(pack, "n long, bins binary, y binary, drawn binary")
    return pinned(packed).rdd.mapPartitions(joined)


# --- splits ------------------------------------------------------------------------------------


@dataclass
class Growth:
    """How splits are judged and leaves valued."""

    l2: float
    rate: float
    steps: float
    cuts: list[list[float]]
    least_weight: int = 1

    def __post_init__(self):
        self.sizes = [len(c) + 1 for c in self.cuts]
        #: Where the bins of each feature begin among those of all features, and their number.
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        #: Features that are counted together, as long as the pairs (or triples...) of their bins are few.
        self.groups: list[list[int]] = []
        for f in sorted(range(len(self.sizes)), key=lambda f: -self.sizes[f]):
            fitting = (g for g in self.groups if self._size(g) * self.sizes[f] <= PAIRED)
            found = next(fitting, None)
            if found is None:
                self.groups.append([f])
            else:
                found.append(f)

    def _size(self, group: list[int]) -> int:
        return math.prod(self.sizes[f] for f in group)

    def paired(self, bins: np.ndarray) -> np.ndarray:
        """For each group of features the joint bin of each row (groups x rows)."""
        kind = np.min_scalar_type(max(map(self._size, self.groups)))
        out = np.zeros((len(self.groups), bins.shape[1]), kind)
        for own, group in zip(out, self.groups):
            for f in group:
                own *= kind.type(self.sizes[f])
                own += bins[f]
        return out

    def by_feature(self, group: list[int], sums: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Sums by (node, joint bin) as sums by (node, bin) of each feature of the group."""
        whole = sums.reshape(-1, *[self.sizes[f] for f in group])
        for i, f in enumerate(group, 1):
            yield f, whole.sum(axis=tuple(k for k in range(1, whole.ndim) if k != i))


_SPLIT = ["node", "f", "b", "gl", "hl", "ga", "ha", "gain"]


def _gain(gl, hl, ga, ha, l2: float):
    return gl * gl / (hl + l2) + (ga - gl) * (ga - gl) / (ha - hl + l2) - ga * ga / (ha + l2)


def columns(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``table[:, rows]`` with each line in one piece; an index gives it column by column, and each ``take`` from a line copies it all."""
    return table.take(rows, axis=1)


def _sums(at: np.ndarray, values: np.ndarray, size: int, small: bool) -> np.ndarray:
    """Exact sums of whole numbers by position; ``small``: doubles hold all of them."""
    if small:
        return np.bincount(at, values, size)
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def cell_sums(bins: np.ndarray, pairs: np.ndarray | None, rows: np.ndarray | None, node: np.ndarray | None, nodes: int,
              residual: np.ndarray, weight: np.ndarray | None, growth: Growth) -> np.ndarray:
    """Sums of (weighted residuals, weights) by node and bin, the bins of all features in turn; nodes are numbered from 0.

    All arguments are those of the rows ``rows`` (None: all rows) but ``bins`` and ``pairs``, which have all rows. With one node,
    ``node`` may be None.
    """
    out = np.empty((2, nodes, growth.starts[-1]), np.int64)
    small = np.abs(residual).sum(dtype=np.float64) < 2.0 ** 52
    values = residual.astype(np.float64) if small else residual
    counts = None if weight is None else weight.astype(np.float64)
    together = pairs is not None and nodes * PAIRED <= len(residual)
    for group, own in zip(growth.groups, pairs) if together else (([f], own) for f, own in enumerate(bins)):
        per_node = growth._size(group)
        cell = own if rows is None else own.take(rows)
        cell = cell.astype(np.int64) if node is None else node * per_node + cell
        size = nodes * per_node
        for k, sums in enumerate((_sums(cell, values, size, small), np.bincount(cell, counts, size))):
            for f, one in growth.by_feature(group, sums):
                out[k, :, growth.starts[f]:growth.starts[f + 1]] = one
    return out


def best_splits(sums: np.ndarray, growth: Growth) -> dict[str, np.ndarray]:
    """The best split of each node that has one, by columns; ties go to the lower feature, then to the lower bin."""
    out = {c: [] for c in _SPLIT}
    feature = np.repeat(np.arange(len(growth.sizes)), growth.sizes)
    first = growth.starts[feature]
    for lo in range(0, sums.shape[1], JUDGED):
        up = np.zeros((2, min(JUDGED, sums.shape[1] - lo), sums.shape[2] + 1), np.int64)
        sums[:, lo:lo + JUDGED].cumsum(2, out=up[:, :, 1:])
        s, hl = up[:, :, 1:] - up[:, :, first]
        gl = s / growth.steps
        end = growth.sizes[0] - 1
        ga, ha = gl[:, end:end + 1], hl[:, end:end + 1]
        fits = (hl >= growth.least_weight) & (ha - hl >= growth.least_weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, _gain(gl, hl, ga, ha, growth.l2), -np.inf)
        best = gain.argmax(1)
        at = np.flatnonzero(gain[np.arange(len(best)), best] > LEAST_GAIN)
        c = best[at]
        found = (at + lo, feature[c], c - first[c], gl[at, c], hl[at, c], ga[at, 0], ha[at, 0], gain[at, c])
        for name, x in zip(_SPLIT, found):
            out[name].append(x)
    return {c: np.concatenate(x) for c, x in out.items()}


def add_splits(nodes: Nodes, growth: Growth, tree: int, at: np.ndarray, splits: dict[str, np.ndarray]) -> np.ndarray:
    """Turn the leaves ``at`` of a tree into splits; the left ones of the new leaves, each before its right one."""
    first = len(nodes.tree)
    gl, hl, ga, ha = (splits[c] for c in ("gl", "hl", "ga", "ha"))
    value = np.stack([growth.rate * gl / (hl + growth.l2), growth.rate * (ga - gl) / (ha - hl + growth.l2)], 1)
    nodes.extend(tree, value.ravel(), np.stack([hl, ha - hl], 1).ravel())
    left = first + 2 * np.arange(len(at))
    flat = np.concatenate([np.asarray(c, np.float64) for c in growth.cuts])
    starts = np.concatenate([[0], np.cumsum([len(c) for c in growth.cuts])])
    for column, x in (("feature", splits["f"]), ("cut", splits["b"]), ("left", left), ("gain", splits["gain"]),
                      ("threshold", flat[starts[splits["f"]] + splits["b"]])):
        np.asarray(getattr(nodes, column))[at] = x
    return left


class Level:
    """The open nodes of a level: which of them to count, and the sums of all from those."""

    def __init__(self, size: int):
        self.size, self._parents, self._side = size, None, None
        self.slot = np.arange(size)  # of each open node among those to count, or -1
        self.counted = size

    def all_sums(self, counted: np.ndarray) -> np.ndarray:
        if self._parents is None:
            return counted
        out = np.empty((2, self.size, *counted.shape[2:]), np.int64)
        which = 2 * np.arange(self.counted) + self._side
        out[:, which] = counted
        out[:, which ^ 1] = self._parents - counted
        return out

    @classmethod
    def below(cls, sums: np.ndarray | None, splits: dict[str, np.ndarray]) -> "Level":
        """The level of the children of ``splits``, two for each in turn; ``sums`` are those of their level."""
        level = cls(2 * len(splits["node"]))
        if sums is not None:
            level.counted = len(splits["node"])
            level._parents = sums[:, splits["node"]]
            level._side = (splits["ha"] - splits["hl"] < splits["hl"]).astype(np.int64)
            level.slot = np.full(level.size, -1)
            level.slot[2 * np.arange(level.counted) + level._side] = np.arange(level.counted)
        return level


def subtree(bins: np.ndarray, pairs: np.ndarray | None, residual: np.ndarray, weight: np.ndarray | None, depth: int,
            growth: Growth, reached: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Splits below a node by columns; nodes are numbered as they arise, from 0 for the node itself.

    ``residual`` is multiplied by the weight. ``reached`` gets the last node of each row.
    """
    out = {c: [np.empty(0, np.int64)] for c in _SPLIT}
    number, known, level = np.zeros(1, np.int64), 1, Level(1)
    # The positions of the rows of each open node while these are few; then the rows by node, with their first positions.
    apart, node, held = [np.arange(bins.shape[1])], np.empty(0, np.int64), None

    def only(rows: np.ndarray) -> None:
        nonlocal bins, pairs, residual, weight, node, held
        bins, residual, node = columns(bins, rows), residual[rows], node[rows]
        pairs, weight = None if pairs is None else columns(pairs, rows), None if weight is None else weight[rows]
        held = None if held is None else held[rows]

    for step in range(depth):
        sums = None
        if apart is not None and level.size > APART:
            rows, node = np.concatenate(apart), np.repeat(np.arange(level.size), [len(r) for r in apart])
            bins, residual, held, apart = columns(bins, rows), residual[rows], None if reached is None else rows, None
            pairs, weight = None if pairs is None else columns(pairs, rows), None if weight is None else weight[rows]
        if apart is None and level.counted * PAIRED > len(node):
            pairs = None
        if apart is not None:
            parts = []
            for k in np.flatnonzero(level.slot >= 0):
                rows = apart[k] if step else None
                some = (x if x is None or rows is None else x.take(rows) for x in (residual, weight))
                parts.append(cell_sums(bins, pairs, rows, None, 1, *some, growth))
            sums = level.all_sums(np.concatenate(parts, axis=1))
            found = best_splits(sums, growth)
        elif level.counted <= TOGETHER:
            slot = level.slot[node]
            rows = np.flatnonzero(slot >= 0)
            some = (x if x is None else x[rows] for x in (residual, weight))
            sums = level.all_sums(cell_sums(bins, pairs, rows, slot[rows], level.counted, *some, growth))
            found = best_splits(sums, growth)
        else:
            # Rows by node, so that a block of nodes is a block of rows.
            only(np.argsort(node, kind="stable"))
            parts = []
            for lo in range(0, level.size, TOGETHER):
                rows = slice(*np.searchsorted(node, [lo, lo + TOGETHER]))
                part = best_splits(cell_sums(bins[:, rows], None, None, node[rows] - lo, min(TOGETHER, level.size - lo),
                                             residual[rows], None if weight is None else weight[rows], growth), growth)
                part["node"] += lo
                parts.append(part)
            found = {c: np.concatenate([p[c] for p in parts]) for c in _SPLIT}
        at = found["node"]
        if not len(at):
            break
        for c in _SPLIT:
            out[c].append(number[at] if c == "node" else found[c])
        if apart is not None:
            if reached is not None:
                for k in np.setdiff1d(np.arange(level.size), at):
                    reached[apart[k]] = number[k]
            below = []
            for k, f, b in zip(at, found["f"], found["b"]):
                right = (bins[f].take(apart[k]) if step else bins[f]) > b
                below += [apart[k].compress(~right), apart[k].compress(right)]
            apart = below
        else:
            place = np.full(level.size, -1)
            place[at] = np.arange(len(at))
            split = place[node]
            if len(at) < level.size:
                stays = split >= 0
                if reached is not None:
                    reached[held[~stays]] = number[node[~stays]]
                only(np.flatnonzero(stays))
                split = split[stays]
            node = 2 * split + (bins.ravel()[(found["f"] * bins.shape[1])[split] + np.arange(len(node))] > found["b"][split])
        number = known + np.arange(2 * len(at))
        known += 2 * len(at)
        # Sums of very many nodes aren't kept: their children are counted in blocks.
        level = Level.below(sums if 2 * len(at) <= TOGETHER else None, found)
    if reached is not None and apart is None:
        reached[held] = number[node]
    elif reached is not None:
        for k, rows in enumerate(apart):
            reached[rows] = number[k]
    return {c: np.concatenate(v) for c, v in out.items()}


def add_subtree(nodes: Nodes, growth: Growth, node: int, splits: dict[str, np.ndarray]) -> None:
    """What ``subtree`` found below ``node``."""
    own = splits["node"].astype(np.int64)
    if len(own):
        add_splits(nodes, growth, nodes.tree[node], np.where(own == 0, node, len(nodes.tree) + own - 1), splits)


def _added(sums: RDD) -> np.ndarray:
    """Many partial results meet on the executors first."""
    return sums.treeReduce(lambda x, y: x + y, 1 if sums.getNumPartitions() <= 32 else 2)


# --- boosting ----------------------------------------------------------------------------------


@dataclass
class Prepared:
    """What a fit of trees begins with: rows with features, target in steps and key; cuts; steps; number of rows; sum of targets."""

    rows: DataFrame
    cuts: list[list[float]]
    steps: float
    n: int
    total: int


def prepare(train: DataFrame, order: list[str], target: str, bins: int, key: str | Column | None = None) -> Prepared:
    """Rows written once and cut; several fits may begin with the same. Forests need a key."""
    more = {} if key is None else {"_key": (F.col(key) if isinstance(key, str) else key).cast("string")}
    clean = train.select(*[(F.col(c).cast("double") + 0.0).alias(f"x{i}") for i, c in enumerate(order)],
                         F.col(target).cast("double").alias("target"), *[c.alias(name) for name, c in more.items()])
    clean = pinned(clean)
    names = [f"x{i}" for i in range(len(order))]
    cuts, steps = find_cuts(clean, names, bins), power_step(clean, "target")
    rows = clean.select(*names, in_steps(F.col("target"), steps).alias("y"), *more)
    total = rows.agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).first()
    return Prepared(rows, cuts, steps, total["n"], total["s"])


def fit_boosted(train: DataFrame, order: list[str], target: str, rounds: int, depth: int, rate: float, bins: int,
                l2: float = 1.0, task_rows: int = TASK_ROWS, ready: Prepared | None = None) -> TreeModel:
    """Trees one after the other, each on the residuals of those before it (the gradients of squared errors)."""
    ready = ready or prepare(train, order, target, bins)
    cuts, steps, n = ready.cuts, ready.steps, ready.n
    growth = Growth(l2, rate, steps, cuts)
    nodes, roots, base = Nodes(), [], ready.total / steps / n
    whole = n <= task_rows
    blocks = in_blocks(ready.rows.drop("_key"), order, target, cuts, steps, n, whole)
    if whole:
        roots, columns = blocks.map(lambda b: _boosted_by_one_task(b, base, rounds, depth, growth)).first()
        return TreeModel(order, base, False, roots, Nodes(*columns))
    # Bins, y, prediction and what is left of y.
    now = blocks.map(lambda b: (b[0], b[1], *_left(b[1], np.full(len(b[1]), base), steps)))
    before = None
    for turn in range(rounds):
        now.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        if turn and turn % PINNED_EVERY == 0:
            now.checkpoint()
        root = nodes.add(turn, 0.0, n)
        roots.append(root)
        left_over = _grow_by_levels(now, nodes, root, depth, growth)
        if before is not None:
            before.unpersist()
        if len(nodes.tree) == root + 1:
            # No split: the leaf takes its share of what is left.
            if left_over is None:
                left_over = now.map(lambda b: int(b[3].sum())).sum()
            nodes.value[root] = rate * (left_over / steps) / (n + l2)
        before, now = now, now.map(_next_round(_own(nodes, root), np.array(nodes.value[root:]), depth, steps))
    if before is not None:
        before.unpersist()
    return TreeModel(order, base, False, roots, nodes)


def _boosted_by_one_task(block: Block, base: float, rounds: int, depth: int, growth: Growth) -> tuple[list[int], list[array]]:
    """The roots and the columns of the nodes of all rounds."""
    bins, y, _ = block
    nodes, roots, pairs, reached = Nodes(), [], growth.paired(bins), np.empty(len(y), np.int64)
    pred, residual = _left(y, np.full(len(y), base), growth.steps)
    for turn in range(rounds):
        root = nodes.add(turn, 0.0, len(y))
        roots.append(root)
        add_subtree(nodes, growth, root, subtree(bins, pairs, residual, None, depth, growth, reached))
        if len(nodes.tree) == root + 1:
            nodes.value[root] = growth.rate * (int(residual.sum()) / growth.steps) / (len(y) + growth.l2)
        pred, residual = _left(y, pred + np.array(nodes.value[root:])[reached], growth.steps)
    return roots, list(vars(nodes).values())


def _left(y: np.ndarray, pred: np.ndarray, steps: float) -> tuple[np.ndarray, np.ndarray]:
    return pred, np.floor((y / steps - pred) * steps + 0.5).astype(np.int64)


def _own(nodes: Nodes, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, left) of the last tree alone, its root as node 0."""
    return np.array(nodes.feature[root:]), np.array(nodes.cut[root:]), np.array(nodes.left[root:]) - root


def _next_round(tree, value: np.ndarray, depth: int, steps: float):
    def run(block):
        bins, y, pred, _ = block
        return bins, y, *_left(y, pred + value[walked(bins, 0, depth, *tree)], steps)

    return run


def _grow_by_levels(now: RDD, nodes: Nodes, root: int, depth: int, growth: Growth) -> int | None:
    """Grow a tree, a job a level (more for very many nodes); the sum of the residuals if it has no split."""
    open_nodes, level, whole = np.array([root]), Level(1), None
    for step in range(depth):
        tree, slot_of = _own(nodes, root), np.full(len(nodes.tree) - root, -1)
        slot_of[open_nodes - root] = level.slot
        parts = []
        for lo in range(0, level.counted, TOGETHER):
            hi = min(lo + TOGETHER, level.counted)

            def count(block, tree=tree, slot_of=slot_of, lo=lo, hi=hi, step=step):
                bins, _, _, residual = block
                pairs = growth.paired(bins) if (hi - lo) * PAIRED <= bins.shape[1] else None
                if step == 0:
                    return cell_sums(bins, pairs, None, None, 1, residual, None, growth)
                slot = slot_of[walked(bins, 0, step, *tree)]
                rows = np.flatnonzero((slot >= lo) & (slot < hi))
                return cell_sums(bins, pairs, rows, slot[rows] - lo, hi - lo, residual[rows], None, growth)

            parts.append(_added(now.map(count)))
        sums = level.all_sums(np.concatenate(parts, axis=1))
        if step == 0:
            whole = int(sums[0, 0, :growth.sizes[0]].sum())
        found = best_splits(sums, growth)
        if not len(found["node"]):
            break
        left = add_splits(nodes, growth, nodes.tree[root], open_nodes[found["node"]], found)
        open_nodes = np.stack([left, left + 1], 1).ravel()
        level = Level.below(sums, found)
    return whole


# --- forests -----------------------------------------------------------------------------------


def fit_forest(train: DataFrame, order: list[str], target: str, key: str | Column, trees: int, depth: int, bins: int,
               seed: int, least_weight: int = 1, task_rows: int = SUBTREE_ROWS, ready: Prepared | None = None) -> TreeModel:
    """Trees on bootstrap samples: a row's weight in a tree is a Poisson draw from a hash of its key."""
    ready = ready or prepare(train, order, target, bins, key)
    rows, cuts, steps, n = ready.rows, ready.cuts, ready.steps, ready.n
    growth = Growth(0.0, 1.0, steps, cuts, least_weight)
    nodes = Nodes()
    sample = in_blocks(rows, order, target, cuts, steps, n, False, trees, seed).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    totals = _added(sample.map(lambda b: np.array([[w @ b[1], w.sum()] for w in (d.astype(np.int64) for d in b[2])])))
    for t, (s, h) in enumerate(totals.tolist()):
        nodes.add(t, s / steps / h if h else 0.0, h)
    open_nodes, small = list(range(trees)), {}
    for level in range(depth):
        small |= {i: depth - level for i in open_nodes if nodes.weight[i] <= task_rows}
        large = [i for i in open_nodes if nodes.weight[i] > task_rows]
        open_nodes = _split_large(sample, level, large, nodes, growth)
    _grow_small(sample, small, n, nodes, growth, depth)
    sample.unpersist()
    return TreeModel(order, 0.0, True, list(range(trees)), nodes)


def _trees(nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(nodes.feature), np.array(nodes.cut), np.array(nodes.left)


def _by_tree(wanted: list[int], nodes: Nodes) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i in wanted:
        out.setdefault(nodes.tree[i], []).append(i)
    return out


def _split_large(sample: RDD, level: int, wanted: list[int], nodes: Nodes, growth: Growth) -> list[int]:
    """Split what can be split of the nodes ``wanted``, all at one level; the new nodes."""
    new, table = [], _trees(nodes)
    for lo in range(0, len(wanted), JUDGED):
        some = wanted[lo:lo + JUDGED]
        by_tree, slot_of = _by_tree(some, nodes), np.full(len(table[0]), -1)
        slot_of[some] = np.arange(len(some))

        def count(block, by_tree=by_tree, slot_of=slot_of, size=len(some)):
            bins, y, drawn = block
            out = np.zeros((2, size, growth.starts[-1]), np.int64)
            pairs = growth.paired(bins)
            for t, own in by_tree.items():
                slot = slot_of[walked(bins, t, level, *table)]
                rows = np.flatnonzero((slot >= 0) & (drawn[t] > 0))
                w, at = drawn[t][rows].astype(np.int64), slot_of[own]
                out[:, at] = cell_sums(bins, pairs, rows, np.searchsorted(at, slot[rows]), len(own), y[rows] * w, w, growth)
            return out

        found = best_splits(_added(sample.map(count)), growth)
        for i, node in enumerate(found["node"]):
            one = {c: x[i:i + 1] for c, x in found.items()}
            left = int(add_splits(nodes, growth, nodes.tree[some[node]], np.array([some[node]]), one)[0])
            new += [left, left + 1]
    return new


def _grow_small(sample: RDD, small: dict[int, int], n: int, nodes: Nodes, growth: Growth, depth: int) -> None:
    """Finish the nodes ``small`` (node: levels that are left), each in one task; trees that are one node share its rows."""
    context = sample.context
    roots = [i for i, levels in small.items() if levels == depth]
    most, table, cores = max(8 * n, SENT_ROWS), _trees(nodes), context.defaultParallelism
    # Small tasks end at about the same time; up to four a core, if they are sent at once.
    groups = min(len(roots), max(2 * cores, min(4 * cores, most // n)))
    units = [(roots[k::groups], n) for k in range(groups)] + [([i], nodes.weight[i]) for i in small if small[i] < depth]
    while units:
        batch, size = [], 0
        while units and (not batch or size + units[-1][1] <= most):
            own, weight = units.pop()
            batch.append(own)
            size += weight
        batch.sort(key=lambda own: nodes.tree[own[0]])
        tree_of = {i: nodes.tree[i] for own in batch for i in own}

        def send(block, batch=batch, tree_of=tree_of):
            bins, y, drawn = block
            last, at = None, None
            for k, own in enumerate(batch):
                t = tree_of[own[0]]
                if small[own[0]] == depth:
                    yield k, (bins, y, drawn[[tree_of[i] for i in own]])
                    continue
                if last != t:
                    last, at = t, walked(bins, t, depth, *table)
                rows = np.flatnonzero((at == own[0]) & (drawn[t] > 0))
                if len(rows):
                    yield k, (columns(bins, rows), y[rows], columns(drawn[[t]], rows))

        def finish(received, batch=batch):
            held: dict[int, list] = {}
            for k, part in received:
                held.setdefault(k, []).append(part)
            while held:
                k, parts = held.popitem()
                bins, y, drawn = (np.concatenate(x, axis=-1) for x in zip(*parts))
                del parts
                pairs = growth.paired(bins)
                for i, weight in zip(batch[k], drawn):
                    rows = np.flatnonzero(weight)
                    w = weight[rows].astype(np.int64)
                    yield i, subtree(columns(bins, rows), columns(pairs, rows), y[rows] * w, w, small[i], growth)

        done = sample.flatMap(send).partitionBy(len(batch), lambda k: k).mapPartitions(finish).collect()
        done.sort(key=lambda x: -x[0])
        while done:
            # What is added is no longer held.
            add_subtree(nodes, growth, *done.pop())
        if units:
            # Shuffle files stay until the driver collects its garbage.
            gc.collect()
            context._jvm.System.gc()
