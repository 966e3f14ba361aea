"""Boosted regression trees and forests, many at once.

The boosted trees are those of Spark's ``GBTRegressor`` (squared error, at most 32 bins
of a feature, candidates from the same sample), found from the same sums. Spark
fits one model at a time and keeps its rows in the executors' caches; here all
fits of a table read the same compact blocks, one job per level of a round, and
no row is kept: what earlier trees say of a row is worked out again from its
bins. A block has the places of the values among all candidates, the targets
and a bit per set of learning rows.

A forest draws as often as Spark's does (Poisson counts with mean one per tree and
row, some features per node), from seeds of its own: a block, a tree and a node
draw the same in every fit, so smaller forests are parts of larger ones and are
not fitted again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, partial
from math import ceil, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.session import settings
from tidegauge.sources.tables import materialize

#: Bins of a feature, deepest tree.
BINS, DEEPEST = 32, 6
#: Rows from which Spark's learner takes split candidates (a larger table is sampled).
CANDIDATE_ROWS = 10_000
#: Bytes of sums that reach the driver as they are; more are added up by tasks first.
DRIVER_BYTES = 128_000_000
EPSILON = np.finfo(float).eps
_POWER = np.zeros(65536, np.uint8)  # the place of the only bit of a number
_POWER[1 << np.arange(16)] = np.arange(16)


@dataclass
class Part:
    """The rows of a table that a fit learns from. Fits of parts of one table are made together, by ``fit_all``."""

    table: DataFrame
    keep: Column | None = None

    def rows(self) -> DataFrame:
        return self.table if self.keep is None else self.table.where(self.keep)


@dataclass
class Tree:
    """Splits in heap order (node ``i`` has the children ``2i + 1`` and ``2i + 2``); a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray  # times the rows of the node

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n))

    def pruned(self) -> Tree:
        """Leaves of one parent that say the same are one leaf, as in Spark's models."""
        for i in range(len(self.feature) // 2 - 1, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            if self.feature[i] >= 0 and self.feature[a] < 0 and self.feature[b] < 0 and self.value[a] == self.value[b]:
                self.feature[i], self.value[i], self.gain[i] = -1, self.value[a], 0.0
        return self


@dataclass
class ClassTree:
    """As ``Tree``, with the weight of each class in each node."""

    feature: np.ndarray
    cut: np.ndarray
    sums: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int, classes: int) -> ClassTree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros((n, classes)), np.zeros(n))

    def cut_off(self, depth: int) -> ClassTree:
        """The tree of that depth; leaves of one parent with the same class are one leaf, as in Spark's models."""
        n = 2 ** (depth + 1) - 1
        out = ClassTree(self.feature[:n].copy(), self.cut[:n].copy(), self.sums[:n].copy(), self.gain[:n].copy())
        out.feature[2 ** depth - 1:] = -1
        for i in range(2 ** depth - 2, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            if out.feature[i] >= 0 and out.feature[a] < 0 and out.feature[b] < 0 and out.sums[a].argmax() == out.sums[b].argmax():
                out.feature[i] = -1
        out.gain[out.feature < 0] = 0.0
        return out


@dataclass
class BoostedRegression:
    """A model; before its fit the parameters alone. It stands for Spark's ``GBTRegressionModel`` here."""

    part: Part | None
    target: str
    rounds: int = 10
    depth: int = 4
    step: float = 0.1
    seed: int = 42
    weight: str | None = None
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> list[float]:
        sums = np.zeros(len(self.cuts))
        for tree in self.trees:
            split = tree.feature >= 0
            np.add.at(sums, tree.feature[split], tree.gain[split])
        return (sums / (sums.sum() or 1.0)).tolist()

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Of rows of feature values; NaN goes to the right."""
        bins = [np.searchsorted(c, values[:, i]) for i, c in enumerate(self.cuts)]
        pairs = _pairs(bins, _width(self.cuts))
        out = np.zeros(len(values))
        for packed, said in self._tables:
            _add(out, packed, pairs, said, self.depth)
        return out

    @cached_property
    def _tables(self) -> list[tuple]:
        return _spoken(self.trees, 0, self.depth, self.step, len(self.cuts), _width(self.cuts))

    def transform(self, df: DataFrame) -> DataFrame:
        """Attach ``prediction``."""
        model = self.alone()

        @F.arrow_udf("double")
        def prediction(vectors: pa.Array) -> pa.Array:
            return pa.array(model.predict(_values(vectors)))

        return df.withColumn("prediction", prediction(vector_to_array("features")))

    def alone(self) -> BoostedRegression:
        """The model without its rows, as sent to tasks."""
        return replace(self, part=None)


@dataclass
class Forest:
    """A forest of classes; before its fit the parameters alone. It stands for Spark's model, with ``__shares`` as its scores."""

    part: Part | None
    target: str  # class indexes
    classes: int
    count: int = 20
    depth: int = 5
    subset: str = "auto"
    bootstrap: bool = True
    seed: int = 42
    class_weights: Sequence[float] | None = None
    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[ClassTree] = field(default_factory=list)

    def subset_size(self, features: int) -> int:
        if self.subset == "all" or (self.subset == "auto" and self.count == 1):
            return features
        return ceil(sqrt(features))

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> list[float]:
        sums = np.zeros(len(self.cuts))
        for tree in self.trees:
            own, split = np.zeros(len(self.cuts)), tree.feature >= 0
            np.add.at(own, tree.feature[split], tree.gain[split])
            sums += own / (own.sum() or 1.0)
        return (sums / (sums.sum() or 1.0)).tolist()

    def shares(self, values: np.ndarray) -> np.ndarray:
        """Class shares of rows of feature values, averaged over the trees."""
        pairs = _pairs([np.searchsorted(c, values[:, i]) for i, c in enumerate(self.cuts)], _width(self.cuts))
        out = np.zeros((len(values), self.classes))
        words, tables = self._tables
        _, lanes = _lanes(self.depth)
        for k, packed in enumerate(words):
            word = _word(packed, pairs)
            for lane, table in enumerate(tables[k * lanes:(k + 1) * lanes]):
                out += table[_place(word, lane, self.depth)]
        return out / out.sum(1, keepdims=True)

    @cached_property
    def _tables(self) -> tuple[list, list]:
        words = _packs(self.trees, self.depth, len(self.cuts), _width(self.cuts))
        return words, [_leaf_shares(t, self.depth) for t in self.trees]

    def alone(self) -> Forest:
        """The model without its rows, as sent to tasks."""
        return replace(self, part=None)

    def transform(self, df: DataFrame) -> DataFrame:
        """Attach ``__shares`` and ``prediction``, the first class with the largest share."""
        model = self.alone()

        @F.arrow_udf("array<double>")
        def shares(vectors: pa.Array) -> pa.Array:
            found = model.shares(_values(vectors))
            starts = pa.array(np.arange(0, found.size + 1, model.classes, dtype=np.int32))
            return pa.ListArray.from_arrays(starts, pa.array(found.ravel()))

        scored = df.withColumn("__shares", shares(vector_to_array("features")))
        return scored.withColumn("prediction", (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double"))

    def predict(self, values: np.ndarray) -> np.ndarray:
        return self.shares(values).argmax(1).astype(float)


@dataclass
class OutOfFold:
    """Models of the folds of a table; each row is scored by the model of its fold."""

    models: Sequence[BoostedRegression]
    fold: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Attach ``prediction``; ``fold`` is the place of a model."""
        return df.withColumn("prediction", out_of_fold_predictions([[m] for m in self.models], self.fold)[0])


def out_of_fold_predictions(models: Sequence[Sequence[BoostedRegression | Forest]], fold: str) -> Column:
    """What the models of a row's fold say of its ``features``, as an array; ``models`` has a list for each fold."""
    alone = [[m.alone() for m in some] for some in models]
    width = len(alone[0])

    @F.arrow_udf("array<double>")
    def predictions(vectors: pa.Array, folds: pa.Array) -> pa.Array:
        values, folds = _values(vectors), folds.to_numpy(zero_copy_only=False)
        out = np.full((len(values), width), np.nan)
        for i, some in enumerate(alone):
            own = np.flatnonzero(folds == i)
            for k, model in enumerate(some):
                out[own, k] = model.predict(values[own])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))

    return predictions(vector_to_array("features"), F.col(fold))


def _values(vectors: pa.Array) -> np.ndarray:
    """A row per vector."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), -1)


# --------------------------------------------------------------------------- trees over bins


def _width(cuts: Sequence[np.ndarray]) -> int:
    """Most bins of a feature; the rule of the candidates can give some more than ``BINS``."""
    return max((len(c) for c in cuts), default=0) + 1


def _pairs(bins: Sequence[np.ndarray], width: int) -> list[np.ndarray]:
    """The bins of two features as one number, so that one look-up serves both."""
    bins = [b.astype(np.intp, copy=False) for b in bins]
    if len(bins) % 2:
        bins = [*bins, np.zeros_like(bins[0])]
    return [a * width + b for a, b in zip(bins[::2], bins[1::2])]


def _lanes(depth: int) -> tuple[int, int]:
    """Bits of a tree in a word, and trees in a word."""
    bits = max(16, 2 ** depth)
    return bits, 64 // bits


def _masks(tree: Tree, depth: int, features: int, bins: int) -> np.ndarray:
    """Per feature and bin the leaves of full depth that a row can reach; all features leave one bit."""
    masks = np.full((features + features % 2, bins), 2 ** (2 ** depth) - 1, np.uint64)
    for i in np.flatnonzero(tree.feature[:2 ** depth - 1] >= 0):
        level = int(i + 1).bit_length() - 1
        width = 2 ** (depth - level)
        first = (int(i) + 1 - 2 ** level) * width
        left, right = (((1 << width // 2) - 1) << first), (((1 << width // 2) - 1) << (first + width // 2))
        gone = np.where(np.arange(bins) <= tree.cut[i], np.uint64(right), np.uint64(left))
        masks[tree.feature[i]] &= ~gone
    for i in np.flatnonzero(tree.feature[:2 ** depth - 1] < 0):  # a leaf above, or what lies below it: the first bit stands for all
        level = int(i + 1).bit_length() - 1
        width = 2 ** (depth - level)
        masks[0] &= ~np.uint64(((1 << width) - 2) << ((int(i) + 1 - 2 ** level) * width))
    return masks


def _joined(masks: np.ndarray) -> list[np.ndarray]:
    return [(a[:, None] & b[None, :]).ravel() for a, b in zip(masks[::2], masks[1::2])]


def _packs(trees: Sequence[Tree], depth: int, features: int, width: int) -> list[list[np.ndarray]]:
    """Tables by pairs of features; a word has several trees."""
    bits, lanes = _lanes(depth)
    out = []
    for k in range(0, len(trees), lanes):
        word = np.zeros((features + features % 2, width), np.uint64)
        for lane, tree in enumerate(trees[k:k + lanes]):
            word |= _masks(tree, depth, features, width) << np.uint64(lane * bits)
        out.append(_joined(word))
    return out


def _word(packed: Sequence[np.ndarray], pairs: Sequence[np.ndarray]) -> np.ndarray:
    word = packed[0].take(pairs[0])
    for table, pair in zip(packed[1:], pairs[1:]):
        word &= table.take(pair)
    return word


def _place(word: np.ndarray, lane: int, depth: int) -> np.ndarray:
    """The leaf whose bit stands in a lane."""
    if depth <= 4:
        return _POWER.take(word.view(np.uint16)[lane::4])
    bits, _ = _lanes(depth)
    own = word if bits == 64 else word.view(np.uint32)[lane::2]
    return (own.astype(np.float64).view(np.int64) >> 52) - 1023


def _leaves(tree: Tree, depth: int) -> np.ndarray:
    """Values of the leaves of full depth; a leaf above gives its value to the first of its places."""
    out = np.zeros(2 ** depth)
    for i in range(len(tree.feature) - 1, -1, -1):  # upper nodes last
        if tree.feature[i] < 0:
            level = (i + 1).bit_length() - 1
            out[(i + 1 - 2 ** level) * 2 ** (depth - level)] = tree.value[i]
    return out


def _leaf_shares(tree: ClassTree, depth: int) -> np.ndarray:
    """As ``_leaves``, with the class shares of each."""
    out = np.zeros((2 ** depth, tree.sums.shape[1]))
    for i in range(len(tree.feature) - 1, -1, -1):
        if tree.feature[i] < 0 and tree.sums[i].any():
            level = (i + 1).bit_length() - 1
            out[(i + 1 - 2 ** level) * 2 ** (depth - level)] = tree.sums[i] / tree.sums[i].sum()
    return out


def _said(trees: Sequence[Tree], depth: int, first: int, step: float) -> list[np.ndarray]:
    """What trees say by their leaf; the first tree of a model counts whole, the others by ``step``.

    Of shallow trees by the bit of the leaf itself: few of the 65,536 places are ever touched.
    """
    out = []
    for k, tree in enumerate(trees, first):
        values = _leaves(tree, depth) * (step if k else 1.0)
        if depth <= 4:
            by_bit = np.zeros(65536)
            by_bit[1 << np.arange(len(values))] = values
            values = by_bit
        out.append(values)
    return out


def _spoken(trees: Sequence[Tree], first: int, depth: int, step: float, features: int, width: int) -> list[tuple]:
    """Tables of trees by pack: the words of their leaves, and what each tree says."""
    _, lanes = _lanes(depth)
    words = _packs(trees, depth, features, width)
    return [(w, _said(trees[k * lanes:(k + 1) * lanes], depth, first + k * lanes, step)) for k, w in enumerate(words)]


def _add(out: np.ndarray, packed: Sequence[np.ndarray], pairs: Sequence[np.ndarray], said: Sequence[np.ndarray], depth: int) -> None:
    """Add what the trees of a pack say."""
    word = _word(packed, pairs)
    for lane, values in enumerate(said):
        out += values.take(word.view(np.uint16)[lane::4] if depth <= 4 else _place(word, lane, depth))


# --------------------------------------------------------------------------- candidates and blocks


def _thresholds(sample: np.ndarray, weights: np.ndarray, expected: float) -> np.ndarray:
    """Split candidates of a feature by the rule of Spark's learner; ``expected`` is the weight the sample stands for."""
    other = sample != 0
    values, where = np.unique(sample[other], return_inverse=True)
    if not len(values):
        return np.zeros(0)
    counts = np.bincount(where, weights[other])
    seen = counts.sum()
    if expected - seen > EPSILON * other.sum() * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, expected - seen)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= BINS - 1:
        return middle
    stride = expected / BINS
    out, current, goal = [], counts[0], stride
    for i in range(1, len(values)):
        before, current = current, current + counts[i]
        if abs(before - goal) < abs(current - goal):
            out.append(middle[i - 1])
            goal += stride
    return np.array(out)


def _candidates(rows: DataFrame, n: int, weight: str | None, seed: int) -> list[np.ndarray]:
    """Split candidates of each feature, from the rows that Spark's learner would sample."""
    spark = rows.sparkSession
    taken = rows.select(vector_to_array("features").alias("f"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    whole = n if weight is None else taken.agg(F.sum("w")).first()[0]
    share = min(1.0, CANDIDATE_ROWS / n)
    if share < 1:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sample = taken._jdf.javaRDD().sample(False, share, draw)
        taken = DataFrame(spark._jsparkSession.createDataFrame(sample, taken._jdf.schema()), spark)
    found = taken.toArrow()
    if not len(found):
        return []
    w = found["w"].to_numpy()
    values = found["f"].combine_chunks().flatten().to_numpy().reshape(len(found), -1)
    return [_thresholds(values[:, i], w, share * whole) for i in range(values.shape[1])]


def _blocks(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], targets: int, sets: int, kind: str) -> Iterator[pa.RecordBatch]:
    """A row per batch: places among the ``edges``, targets, weights, and bits of the sets, as bytes."""
    for block, batch in enumerate(batches):
        n = batch.num_rows
        if not n:
            continue
        values = _values(batch.column(0))
        member = [batch.column(1 + targets + i).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) for i in range(sets)]
        places = [np.searchsorted(e, values[:, i]).astype(kind) for i, e in enumerate(edges)]
        ys = [batch.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(targets)]
        weight = batch.column(1 + targets + sets).to_numpy(zero_copy_only=False).astype(float)
        plain = bool((weight == 1.0).all())
        yield pa.RecordBatch.from_pydict({
            "id": pa.array([TaskContext.get().partitionId() << 32 | block], pa.int64()),
            "n": pa.array([n], pa.int32()), "places": pa.array([np.stack(places).tobytes()], pa.binary()),
            "ys": pa.array([np.stack(ys).tobytes()], pa.binary()),
            "member": pa.array([np.packbits(np.stack(member), axis=1).tobytes()], pa.binary()),
            "weight": pa.array([b"" if plain else weight.tobytes()], pa.binary())})


# --------------------------------------------------------------------------- sums of a level


@dataclass
class _Fit:
    """What a task needs of a fit: its set of rows, its target, its trees so far and the one that grows."""

    at: int
    own: int
    target: int
    depth: int
    step: float
    trees: list[Tree]
    grown: Tree
    level: int


#: A block is a large row: few reach a task at a time. Shuffle files of a level go when the driver has its sums.
_BLOCKS_ARE_LARGE = {"spark.sql.parquet.columnarReaderBatchSize": "16", "spark.sql.execution.arrow.maxRecordsPerBatch": "16",
                     "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Tables of a run's trees, kept by a Python worker between its tasks.
_KNOWN: dict = {}


def _tables(run: str, fit: _Fit, features: int, width: int) -> list[tuple]:
    if _KNOWN.get("run") != run:
        _KNOWN.clear()
        _KNOWN["run"] = run
    _, lanes = _lanes(fit.depth)
    full = len(fit.trees) // lanes
    out = _KNOWN.setdefault(fit.at, [])
    while len(out) < full:
        k = len(out) * lanes
        out += _spoken(fit.trees[k:k + lanes], k, fit.depth, fit.step, features, width)
    rest = full * lanes
    return [*out[:full], *_spoken(fit.trees[rest:], rest, fit.depth, fit.step, features, width)]


def _level_sums(batches: Iterator[pa.RecordBatch], run: str, fits: list[_Fit], maps: list[list[np.ndarray]], targets: int,
                kind: str, width: int) -> Iterator[pa.RecordBatch]:
    """Per fit the rows, sums and squares of its open nodes, by the bins of each feature."""
    features = len(maps[0])
    half = -(-features // 2)
    size = width * width
    ready = [(f, _tables(run, f, features, width), _packs([f.grown], f.depth, features, width)[0], 2 ** f.level) for f in fits]
    sums = {f.at: np.zeros((half, 2, 2 ** f.level * size)) for f in fits}
    squares = {f.at: np.zeros(2 ** f.level) for f in fits}
    by_set: dict[int, list] = {}
    for one in ready:
        by_set.setdefault(one[0].own, []).append(one)
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            places = np.frombuffer(row["places"], kind).reshape(features, n)
            ys = np.frombuffer(row["ys"], float).reshape(targets, n)
            member = np.unpackbits(np.frombuffer(row["member"], np.uint8).reshape(len(maps), -1), axis=1, count=n)
            weight = np.frombuffer(row["weight"], float) if row["weight"] else None
            for own, some in by_set.items():
                chosen = np.flatnonzero(member[own])
                if not len(chosen):
                    continue
                pairs = _pairs([m.take(p.take(chosen)) for m, p in zip(maps[own], places)], width)
                w = None if weight is None else weight.take(chosen)
                for f, packs, growing, nodes in some:
                    y = ys[f.target].take(chosen)
                    if f.trees:
                        said = np.zeros(len(chosen))
                        for packed, tables in packs:
                            _add(said, packed, pairs, tables, f.depth)
                        y = 2.0 * (y - said)
                    wy = y if w is None else w * y
                    if f.level:
                        place = _place(_word(growing, pairs), 0, f.depth)
                        node = (place.astype(np.intp) >> (f.depth - f.level))
                        start = node * size
                        squares[f.at] += np.bincount(node, wy * y, nodes)
                    else:
                        start = None
                        squares[f.at][0] += float(wy @ y)
                    total = sums[f.at]
                    for k, pair in enumerate(pairs):
                        cell = pair if start is None else start + pair
                        total[k, 0] += np.bincount(cell, w, nodes * size)
                        total[k, 1] += np.bincount(cell, wy, nodes * size)
    for f in fits:
        nodes = 2 ** f.level
        pairs = sums[f.at].reshape(half, 2, nodes, width, width)
        each = np.stack([pairs.sum(4), pairs.sum(3)], 1).reshape(2 * half, 2, nodes, width)[:features]
        yield pa.RecordBatch.from_pydict({"fit": pa.array([f.at], pa.int32()), "sums": pa.array(
            [np.concatenate([each.ravel(), squares[f.at]]).tobytes()], pa.binary())})


def _added(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(s, float) for s in parts["sums"].to_pylist())
    return pa.table({"fit": parts["fit"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _grow(tree: Tree, level: int, depth: int, sums: np.ndarray, cuts: Sequence[np.ndarray]) -> None:
    """Split the open nodes of a level at the first best candidate; a node without a gain stays a leaf."""
    nodes, features = 2 ** level, len(cuts)
    squares = sums[-nodes:]
    each = sums[:-nodes].reshape(features, 2, nodes, -1)
    first = nodes - 1
    for node in range(nodes):
        i = first + node
        if level and tree.feature[(i - 1) // 2] < 0:
            continue
        n, s = each[0, 0, node].sum(), each[0, 1, node].sum()
        if not n:
            continue
        if not level:
            tree.value[0] = s / n
        if level and abs((squares[node] - s * s / n) / n) < EPSILON:
            continue
        best = (0.0, -1, 0, 0.0, 0.0)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            left, ls = np.cumsum(each[f, 0, node])[:len(c)], np.cumsum(each[f, 1, node])[:len(c)]
            right, rs = n - left, s - ls
            fine = (left > 0) & (right > 0)
            if not fine.any():
                continue
            with np.errstate(all="ignore"):
                gains = np.where(fine, ls * ls / left + rs * rs / right - s * s / n, -np.inf)
            at = int(gains.argmax())
            if gains[at] > best[0]:
                best = (float(gains[at]), f, at, ls[at] / left[at], rs[at] / right[at])
        if best[1] >= 0:
            tree.gain[i], tree.feature[i], tree.cut[i], tree.value[2 * i + 1], tree.value[2 * i + 2] = best


def _looked_at(batches: Iterator[pa.RecordBatch], targets: int, sets: int, pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of each set and the sum of their marks, by which equal sets are known; or what no learner takes."""
    total, fault = np.zeros((sets, 2), np.uint64), None
    flags = lambda c: c.to_numpy(zero_copy_only=False).astype(bool)
    for batch in batches:
        marks, vector = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), flags(batch.column(1))
        member = [flags(batch.column(2 + targets + i)) for i in range(sets)]
        for i, m in enumerate(member):
            total[i] += np.array([m.sum(), marks[m].sum()], np.uint64)
            if (m & vector).any():
                fault = "vectors of learning rows must be neither null nor NaN nor infinite"
        for t, i in pairs:
            if (member[i] & flags(batch.column(2 + t))).any():
                fault = "targets must be neither null nor NaN"
    yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary()), "fault": pa.array([fault], pa.string())})


def fit_all(models: Sequence[BoostedRegression | None]) -> None:
    """Fit models of parts of tables; those of one table and weight together, equal rounds of equal fits once."""
    groups: dict[tuple, list[BoostedRegression]] = {}
    for m in models:
        if m is not None:
            groups.setdefault((id(m.part.table), m.weight, m.seed), []).append(m)
    for (_, weight, seed), some in groups.items():
        _fit_group(some[0].part.table, some, weight, seed)


@dataclass
class _Blocks:
    """A table in blocks: the set of each part, the candidates of each set and their places among all of them."""

    rows: DataFrame
    own: dict[int, int]
    cuts: list[list[np.ndarray]]
    maps: list[list[np.ndarray]]
    targets: list[str]
    kind: str
    width: int
    tasks: int


def _blocked(table: DataFrame, models: Sequence[BoostedRegression | Forest], weight: str | None, seed: int) -> _Blocks:
    from tidegauge.operators.learned import run_together

    spark = table.sparkSession
    parts = list({id(m.part): m.part for m in models}.values())
    inside = [p.keep if p.keep is not None else F.lit(True) for p in parts]
    targets = list(dict.fromkeys(m.target for m in models))
    vector = vector_to_array("features")
    checked = table.select(
        F.xxhash64(F.monotonically_increasing_id()).alias("h"),
        F.coalesce(F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True)).alias("v"),
        *[(F.col(t).isNull() | F.isnan(F.col(t).cast("double"))).alias(f"t{i}") for i, t in enumerate(targets)],
        *[F.coalesce(c, F.lit(False)).alias(f"s{i}") for i, c in enumerate(inside)])
    pairs = [(targets.index(m.target), next(i for i, p in enumerate(parts) if p is m.part)) for m in models]
    look = partial(_looked_at, targets=len(targets), sets=len(parts), pairs=sorted(set(pairs)))
    totals = np.zeros((len(parts), 2), np.uint64)
    for r in checked.mapInArrow(look, "sums binary, fault string").collect():
        if r["fault"]:
            raise ValueError(r["fault"])
        totals += np.frombuffer(r["sums"], np.uint64).reshape(-1, 2)
    sets: dict[tuple, int] = {}
    own = {id(p): sets.setdefault((int(totals[i, 0]), int(totals[i, 1])), len(sets)) for i, p in enumerate(parts)}
    firsts = [next(p for p in parts if own[id(p)] == k) for k in range(len(sets))]
    counts = [n for n, _ in sets]
    if not all(counts):
        raise ValueError("a fit has no rows")
    cuts = run_together(spark, [partial(_candidates, p.rows(), n, weight, seed) for p, n in zip(firsts, counts)])
    features = len(cuts[0])
    edges = [np.unique(np.concatenate([c[f] for c in cuts])) for f in range(features)]
    maps = [[np.append(np.searchsorted(c[f], edges[f]), len(c[f])) for f in range(features)] for c in cuts]
    kind = "uint8" if max(map(len, edges)) < 256 else "uint16"
    rows = table.select(vector.alias("f"), *[F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias(f"y{i}") for i, t in enumerate(targets)],
                        *[(p.keep if p.keep is not None else F.lit(True)).alias(f"s{i}") for i, p in enumerate(firsts)],
                        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    write = partial(_blocks, edges=edges, targets=len(targets), sets=len(sets), kind=kind)
    blocks = materialize(rows.mapInArrow(write, "id bigint, n int, places binary, ys binary, member binary, weight binary"))
    tasks = 2 * spark.sparkContext.defaultParallelism
    if blocks.rdd.getNumPartitions() > tasks:
        blocks = blocks.coalesce(tasks)
    return _Blocks(blocks, own, cuts, maps, targets, kind, max(map(_width, cuts)), tasks)


def _fit_group(table: DataFrame, models: Sequence[BoostedRegression], weight: str | None, seed: int) -> None:
    made = _blocked(table, models, weight, seed)
    distinct: dict[tuple, list[BoostedRegression]] = {}
    for m in models:
        distinct.setdefault((made.own[id(m.part)], m.target, m.depth, m.step), []).append(m)
    run, going = uuid.uuid4().hex, []
    for at, ((k, target, depth, step), same) in enumerate(distinct.items()):
        going.append((_Fit(at, k, made.targets.index(target), depth, step, [], Tree.empty(depth), 0), max(m.rounds for m in same), same))
    while going:
        fits = [f for f, _, _ in going]
        size = sum(2 ** f.level * (len(made.maps[0]) * 2 * made.width + 1) * 8 for f in fits)
        found = _sums(made, partial(_level_sums, run=run, fits=fits, maps=made.maps, targets=len(made.targets), kind=made.kind,
                                    width=made.width), size)
        still = []
        for f, rounds, same in going:
            _grow(f.grown, f.level, f.depth, found[f.at], made.cuts[f.own])
            f.level += 1
            open_nodes = (f.grown.feature[2 ** (f.level - 1) - 1:2 ** f.level - 1] >= 0).any()
            if f.level == f.depth or not open_nodes:
                f.trees.append(f.grown.pruned())
                f.grown, f.level = Tree.empty(f.depth), 0
            if len(f.trees) < rounds:
                still.append((f, rounds, same))
                continue
            for m in same:
                m.cuts, m.trees = made.cuts[f.own], f.trees[:m.rounds]
        going = still


def _sums(made: _Blocks, of_task, size: int) -> dict[int, np.ndarray]:
    """The sums of one level of all fits, over all blocks; ``size``: bytes that a task gives."""
    with settings(made.rows.sparkSession, _BLOCKS_ARE_LARGE):
        sums = made.rows.mapInArrow(of_task, "fit int, sums binary")
        if size * made.tasks > DRIVER_BYTES:
            sums = sums.groupBy("fit").applyInArrow(_added, "fit int, sums binary")
        out: dict[int, np.ndarray] = {}
        for r in sums.collect():
            values = np.frombuffer(r["sums"], float)
            out[r["fit"]] = out[r["fit"]] + values if r["fit"] in out else values
        return out


# --------------------------------------------------------------------------- forests


@dataclass
class _Growing:
    """A tree of a forest on its way to a task: its place, its set of rows, its number, its target."""

    at: int
    own: int
    number: int
    target: int
    classes: int
    drawn: bool
    seed: int
    tree: ClassTree


#: Poisson counts with mean one by sixteen random bits.
_POISSON = np.searchsorted(np.cumsum([np.exp(-1.0) / factorial(k) for k in range(12)]),
                           (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


def _class_sums(batches: Iterator[pa.RecordBatch], trees: list[_Growing], level: int, maps: list[list[np.ndarray]], targets: int,
                kind: str, width: int) -> Iterator[pa.RecordBatch]:
    """Per tree the drawn weight of each class by the open nodes and the bins of each feature."""
    features, nodes = len(maps[0]), 2 ** level
    sums = {t.at: np.zeros((features, nodes * t.classes * width)) for t in trees}
    by_set: dict[int, list] = {}
    for t in trees:
        by_set.setdefault(t.own, []).append(t)
    _, lanes = _lanes(level)
    words = {own: _packs([t.tree for t in some], level, features, width) if level else [] for own, some in by_set.items()}
    most = {s: max(t.number for t in trees if t.seed == s) + 1 for s in {t.seed for t in trees}}
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            places = np.frombuffer(row["places"], kind).reshape(features, n)
            ys = np.frombuffer(row["ys"], float).reshape(targets, n)
            member = np.unpackbits(np.frombuffer(row["member"], np.uint8).reshape(len(maps), -1), axis=1, count=n)
            weight = np.frombuffer(row["weight"], float) if row["weight"] else None
            draws = {s: [_POISSON.take(np.random.default_rng([s % 2**32, row["id"], k]).integers(0, 65536, n, np.uint16)) for k in range(m)]
                     for s, m in most.items()}
            for own, some in by_set.items():
                chosen = np.flatnonzero(member[own])
                if not len(chosen):
                    continue
                bins = [m.take(p.take(chosen)) for m, p in zip(maps[own], places)]
                pairs = _pairs(bins, width) if level else []
                w = None if weight is None else weight.take(chosen)
                cells = {t: [ys[t].take(chosen).astype(np.intp) * width + b for b in bins] for t in {t.target for t in some}}
                for k, t in enumerate(some):
                    if level and k % lanes == 0:
                        word = _word(words[own][k // lanes], pairs)
                    drawn = draws[t.seed][t.number].take(chosen).astype(float) if t.drawn else None
                    if w is not None:
                        drawn = w if drawn is None else drawn * w
                    start = _place(word, k % lanes, level).astype(np.intp) * (t.classes * width) if level else 0
                    for f, cell in enumerate(cells[t.target]):
                        sums[t.at][f] += np.bincount(start + cell, drawn, nodes * t.classes * width)
    yield from (pa.RecordBatch.from_pydict({"fit": pa.array([at], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})
                for at, total in sums.items())


def _grow_classes(t: _Growing, level: int, sums: np.ndarray, cuts: Sequence[np.ndarray], weights: Sequence[float] | None, some: int) -> None:
    """Split the open nodes of a level at the best candidate of some features by Gini impurity."""
    tree, nodes = t.tree, 2 ** level
    each = sums.reshape(len(cuts), nodes, t.classes, -1)
    if weights is not None:
        each = each * np.asarray(weights)[:, None]
    for node in range(nodes):
        i = nodes - 1 + node
        if level and tree.feature[(i - 1) // 2] < 0:
            continue
        total = each[0, node].sum(1)
        n = total.sum()
        tree.sums[i] = total
        if not n or 1.0 - (total / n) @ (total / n) < EPSILON:
            continue
        best = 0.0
        for f in sorted(np.random.default_rng([t.seed % 2**32, t.number, i]).permutation(len(cuts))[:some]):
            left = np.cumsum(each[f, node], 1)[:, :len(cuts[f])]
            right = total[:, None] - left
            ln, rn = left.sum(0), right.sum(0)
            fine = (ln > 0) & (rn > 0)
            if not fine.any():
                continue
            with np.errstate(all="ignore"):
                gains = np.where(fine, (left * left).sum(0) / ln + (right * right).sum(0) / rn - (total @ total) / n, -np.inf)
            at = int(gains.argmax())
            if gains[at] > best:
                best = float(gains[at])
                tree.feature[i], tree.cut[i], tree.gain[i] = f, at, best
                tree.sums[2 * i + 1], tree.sums[2 * i + 2] = left[:, at], right[:, at]


def fit_forests(models: Sequence[Forest]) -> None:
    """Fit forests of parts of one table together. Forests of one part that differ in depth and size alone are fitted as one."""
    for seed in dict.fromkeys(m.seed for m in models):
        _fit_forests([m for m in models if m.seed == seed], seed)


def _fit_forests(models: Sequence[Forest], seed: int) -> None:
    made = _blocked(models[0].part.table, models, None, seed)
    features = len(made.maps[0])
    distinct: dict[tuple, list[Forest]] = {}
    for m in models:
        key = (made.own[id(m.part)], m.target, m.classes, m.subset_size(features), m.bootstrap, tuple(m.class_weights or ()))
        distinct.setdefault(key, []).append(m)
    grown = []
    for (own, target, classes, some, drawn, weights), same in distinct.items():
        depth = max(m.depth for m in same)
        trees = [_Growing(0, own, k, made.targets.index(target), classes, drawn, seed, ClassTree.empty(depth, classes))
                 for k in range(max(m.count for m in same))]
        grown.append((trees, depth, some, weights or None, same))
    for at, t in enumerate(t for trees, *_ in grown for t in trees):
        t.at = at
    for level in range(max(depth for _, depth, *_ in grown)):
        open_nodes = slice(2 ** (level - 1) - 1, 2 ** level - 1) if level else slice(0, 0)
        going = [t for trees, depth, *_ in grown for t in trees
                 if level < depth and (not level or (t.tree.feature[open_nodes] >= 0).any())]
        size = sum(features * 2 ** level * t.classes * made.width * 8 for t in going)
        found = _sums(made, partial(_class_sums, trees=going, level=level, maps=made.maps, targets=len(made.targets), kind=made.kind,
                                    width=made.width), size)
        for trees, _, some, weights, _ in grown:
            for t in trees:
                if t.at in found:
                    _grow_classes(t, level, found[t.at], made.cuts[t.own], weights, some)
    for trees, _, _, _, same in grown:
        for m in same:
            m.cuts, m.trees = made.cuts[made.own[id(m.part)]], [t.tree.cut_off(m.depth) for t in trees[:m.count]]
