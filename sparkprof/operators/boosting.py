"""Gradient-boosted trees that are grown from sums of binned rows.

Spark's estimator reads an object per row for every level of every tree.  A tree only sees
the bins of a row's features, so here the rows are binned once, rows of equal bins (and, of
classes, equal label) are added up, and the passes read these cells, packed in blocks.  Rows
that are all different stay as many cells, of some bytes each.  The trees are those of Spark's
estimator: its thresholds, gains, stopping rules and losses, up to the rounding of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Bytes of the rows that are added up at once, and of a block of cells.
_BUFFER, _BLOCK = 32 << 20, 2 << 20
# Bytes of the cells a task reads at most, at least, and of those that one task grows all trees from.
_TASK, _LEAST, _ALONE = 64 << 20, 4 << 20, 16 << 20
# Bytes of the sums of a pass that reach the driver, and of the nodes that are split by one pass.
_COLLECTED, _GROUP = 64 << 20, 32 << 20
# Rows that a task adds up, if there are more than the session's partitions hold.
_TASK_ROWS = 4_000_000
# Trees after which the predictions are made from the first blocks again, so that no lineage grows long.
_CHAIN = 20
_CELL = "key binary, n long, s double, q double"
_PACKED = "bins binary, n binary, s binary, q binary"
# Of many cells the bins (a row per feature), rows, sums and sums of squares of the labels, predictions.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
# As in Spark, a node of less impurity is not split.
_PURE = float(np.finfo(float).eps)


@dataclass
class Tree:
    """Nodes in the order they were made; a split node's children are ``left`` and ``left + 1``."""

    feature: list[int] = field(default_factory=list)  # -1: a leaf
    bin: list[int] = field(default_factory=list)  # the last bin that goes left
    left: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    sums: list[tuple[float, float, float]] = field(default_factory=list)  # rows, sum and sum of squares
    impurity: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, sums: tuple[float, float, float], level: int) -> int:
        for column, value in (
            (self.feature, -1), (self.bin, 0), (self.left, 0), (self.level, level),
            (self.sums, sums), (self.impurity, impurity(*sums)), (self.gain, 0.0),
        ):
            column.append(value)
        return len(self.feature) - 1

    def values(self) -> np.ndarray:
        return np.array([s / n if n else 0.0 for n, s, _ in self.sums])

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node of each cell; ``bins`` has a row per feature."""
        feature, last, left = (np.array(c, np.int64) for c in (self.feature, self.bin, self.left))
        node, cells = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(max(self.level)):
            at = feature[node]
            below = left[node] + (bins[at, cells] > last[node])
            node = np.where(at < 0, node, below)
        return node


def impurity(n, s, q):
    """The variance, computed as Spark's."""
    return (q - s * s / n) / n if n else 0.0


def by_cells(estimator: Estimator) -> Estimator:
    """What fits the estimator's model, of boosted trees by passes over cells."""
    return Boosting(estimator) if isinstance(estimator, GBTClassifier | GBTRegressor) else estimator


class Boosting(Estimator):
    """Fits what a ``GBTClassifier`` or ``GBTRegressor`` would, by passes over cells."""

    def __init__(self, estimator: GBTClassifier | GBTRegressor) -> None:
        super().__init__()
        self.estimator = estimator

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel | GBTRegressionModel:
        estimator = self.estimator
        # The rows of a cell share no draw.
        if estimator.getSubsamplingRate() != 1.0:
            return estimator.fit(dataset)
        candidates = _Candidates.of(estimator, dataset)
        growth = _Growth.of(estimator, candidates.thresholds)
        cells = _cells(dataset, estimator, candidates).persist()
        try:
            size = len(growth.sizes) + 32
            total = cells.count() * size
            cores = dataset.sparkSession.sparkContext.defaultParallelism
            tasks = max(-(-total // _TASK), min(cores, -(-total // _LEAST)) if total > _ALONE else 1)
            packed = cells.coalesce(tasks).mapInArrow(_packer(candidates, max(1, _BLOCK // size)), _PACKED)
            blocks = packed.rdd.map(_read)
            if tasks == 1:
                trees = blocks.mapPartitions(growth.alone).collect()
            else:
                trees = growth.spread(blocks, cells.unpersist)
        finally:
            cells.unpersist()
        return candidates.model(trees, estimator)


@dataclass
class _Candidates:
    """Spark's own candidates of splits, found in a sample of the rows."""

    estimator: object  # in the JVM
    splits: list[list]
    thresholds: list[np.ndarray]
    rows: int

    @classmethod
    def of(cls, estimator: GBTClassifier | GBTRegressor, dataset: DataFrame) -> _Candidates:
        spark = dataset.sparkSession
        ml = spark._jvm.org.apache.spark.ml
        estimator._transfer_params_to_java()
        java, rows = estimator._java_obj, dataset._jdf
        java.transformSchema(rows.schema())
        classes = spark._jvm.scala.Option.apply(2 if _classes(estimator) else None)
        instances = _module(ml.util, "DatasetUtils").extractInstances(java, rows, classes)
        kind = _module(spark._jvm.org.apache.spark.mllib.tree.configuration, "Algo").Regression()
        none = _module(spark._jvm.scala.collection.immutable, "Map").empty()
        strategy = java.getOldBoostingStrategy(none, kind).treeStrategy()
        about = ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, "all")
        found = _module(ml.tree.impl, "RandomForest").findSplits(instances, about, estimator.getSeed())
        splits = [list(of) for of in found]
        thresholds = [np.array([s.threshold() for s in of], float) for of in splits]
        return cls(java, splits, thresholds, about.numExamples())

    def model(self, trees: list[Tree], estimator) -> GBTClassificationModel | GBTRegressionModel:
        """The trees as a model of Spark."""
        sc = SparkContext._active_spark_context
        jvm, gateway = sc._jvm, sc._gateway
        ml, width = jvm.org.apache.spark.ml, len(self.thresholds)
        empty = ml.param.ParamMap.empty()
        tree_model = ml.regression.DecisionTreeRegressionModel
        made = gateway.new_array(tree_model, len(trees))
        weights = gateway.new_array(jvm.double, len(trees))
        for i, tree in enumerate(trees):
            uid = ml.util.Identifiable.randomUID("dtr")
            one = tree_model(uid, self._root(tree, jvm, gateway), width)
            made[i] = self.estimator.copyValues(one, empty)
            weights[i] = estimator.getStepSize() if i else 1.0
        uid = self.estimator.uid()
        if _classes(estimator):
            model = ml.classification.GBTClassificationModel(uid, made, weights, width, 2)
        else:
            model = ml.regression.GBTRegressionModel(uid, made, weights, width)
        self.estimator.copyValues(model.setParent(self.estimator), empty)
        return estimator._copyValues(estimator._create_model(model))

    def _root(self, tree: Tree, jvm, gateway):
        """The nodes from the last to the first; two leaves of one prediction are one leaf."""
        nodes, leaves = {}, {}
        flat = np.array(tree.sums, ">f8")
        sums = gateway.new_array(jvm.double, flat.size)
        jvm.java.nio.ByteBuffer.wrap(flat.tobytes()).asDoubleBuffer().get(sums)
        # Each name of a package is asked of the JVM, so classes are looked up once.
        leaf, inside = jvm.org.apache.spark.ml.tree.LeafNode, jvm.org.apache.spark.ml.tree.InternalNode
        variance, part = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.java.util.Arrays.copyOfRange
        values = tree.values().tolist()
        for i in reversed(range(len(values))):
            three = part(sums, 3 * i, 3 * i + 3)
            stats = variance(three, int(tree.sums[i][0]))
            left = tree.left[i]
            inner = tree.feature[i] >= 0
            if inner and left in leaves and left + 1 in leaves and leaves[left] == leaves[left + 1]:
                inner = False
            if not inner:
                leaves[i] = values[i]
                nodes[i] = leaf(values[i], float(tree.impurity[i]), stats)
                continue
            split = self.splits[tree.feature[i]][tree.bin[i]]
            nodes[i] = inside(
                values[i], float(tree.impurity[i]), float(tree.gain[i]), nodes[left], nodes[left + 1], split, stats
            )
        return nodes[0]


def _module(package, name: str):
    """A Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def _classes(estimator) -> bool:
    return isinstance(estimator, GBTClassifier)


def _cells(dataset: DataFrame, estimator, candidates: _Candidates) -> DataFrame:
    """(key, n, s, q): the bins of the features, and how many rows have them with the sums of their labels.

    Of classes the labels are -1 and 1, and the key ends with the class.
    """
    thresholds, classes = candidates.thresholds, _classes(estimator)
    label = F.col(estimator.getLabelCol()).cast("double")
    rows = dataset.select(
        vector_to_array(estimator.getFeaturesCol()).alias("x"),
        (label * 2 - 1 if classes else label).alias("y"),
    )
    size = len(thresholds) + classes

    def bin_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            key = np.empty((len(batch), size), np.uint8)
            for i, of in enumerate(thresholds):
                key[:, i] = np.searchsorted(of, x[:, i])
            if classes:
                key[:, -1] = y > 0
            held.append((key, y))
            n += len(batch)
            if n * (size + 24) > _BUFFER:
                yield _added(held)
                held, n = [], 0
        if n:
            yield _added(held)

    found = rows.mapInArrow(bin_rows, _CELL)
    session = dataset.sparkSession
    wanted = -(-candidates.rows // _TASK_ROWS)
    if wanted > int(session.conf.get("spark.sql.shuffle.partitions")):
        found = found.repartition(wanted, "key")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of one key become one; keys are sorted by a hash, so some may be left apart."""
    key, y = (np.concatenate(c) for c in zip(*held))
    size = key.shape[1]
    words = np.zeros((len(key), -(-size // 8) * 8), np.uint8)
    words[:, :size] = key
    words = words.view(np.uint64)
    mark = np.zeros(len(key), np.uint64)
    for word in words.T:
        mark = (mark ^ word) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(29)
    order = np.argsort(mark, kind="stable")
    words, y = words[order], y[order]
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])
    n = np.diff(np.r_[first, len(y)])
    keys = np.ascontiguousarray(key[order[first]])
    return pa.RecordBatch.from_arrays(
        [
            pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(size), len(keys), [None, pa.py_buffer(keys)]
            ).cast(pa.binary()),
            pa.array(n, pa.int64()),
            pa.array(np.add.reduceat(y, first)),
            pa.array(np.add.reduceat(y * y, first)),
        ],
        ["key", "n", "s", "q"],
    )


def _packer(candidates: _Candidates, most: int) -> Callable:
    """Packs cells in blocks of ``most``."""
    width = len(candidates.thresholds)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            key = batch.column("key").cast(pa.binary())
            size = len(key[0].as_py()) if len(key) else width
            data = np.frombuffer(key.buffers()[2], np.uint8)
            start = np.frombuffer(key.buffers()[1], np.int32)[key.offset]
            bins = data[start : start + len(key) * size].reshape(len(key), size)[:, :width]
            held.append((bins, *(batch.column(c).to_numpy().astype(float) for c in ("n", "s", "q"))))
            n += len(batch)
            while n >= most:
                whole = [np.concatenate(c) for c in zip(*held)]
                yield _block(*(c[:most] for c in whole))
                held, n = [tuple(c[most:] for c in whole)], n - most
        if n:
            yield _block(*(np.concatenate(c) for c in zip(*held)))

    return pack


def _block(bins: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    columns = zip(("bins", "n", "s", "q"), (np.ascontiguousarray(bins.T), n, s, q))
    return pa.RecordBatch.from_pydict({name: [values.tobytes()] for name, values in columns})


def _read(row: Row) -> Block:
    n, s, q = (np.frombuffer(v, float) for v in row[1:])
    return np.frombuffer(row[0], np.uint8).reshape(-1, len(n)), n, s, q, np.zeros(len(n))


def _targets(n, s, q, f, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sums of what the next tree is fitted to, the loss's negative gradient, and of its square."""
    mean = s / n
    if classes:
        one = 4.0 * mean / (1.0 + np.exp(2.0 * mean * f))
        return n * one, n * one * one
    far = mean - f
    return 2.0 * n * far, 4.0 * (np.maximum(q - s * mean, 0.0) + n * far * far)


@dataclass(frozen=True)
class _Growth:
    """How the trees grow, wherever the cells are."""

    sizes: list[int]  # candidates of each feature
    classes: bool
    trees: int
    step: float
    depth: int
    least: int  # rows of a child
    gained: float

    @classmethod
    def of(cls, estimator: GBTClassifier | GBTRegressor, thresholds: list[np.ndarray]) -> _Growth:
        return cls(
            [len(of) for of in thresholds], _classes(estimator), estimator.getMaxIter(), estimator.getStepSize(),
            estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain(),
        )

    @property
    def shape(self) -> tuple[int, int, int]:
        return 3, len(self.sizes), max(self.sizes) + 1

    def weight(self, place: int) -> float:
        return self.step if place else 1.0

    def alone(self, blocks: Iterable[Block]) -> Iterator[Tree]:
        """All trees, by one task that holds all cells."""
        held = list(blocks)
        for place in range(self.trees):
            tree = self.tree(lambda add, nodes: self.total(add(held), nodes), residual=place > 0)
            update = _updater([(tree, self.weight(place))])
            held = [update(block) for block in held]
            yield tree

    def spread(self, blocks: RDD, ready: Callable) -> list[Tree]:
        """Tree by tree; the predictions so far are kept beside the cells.

        The blocks are an RDD: a plan that reads a kept plan is shown with all it was made of, twice each time.
        """
        trees: list[Tree] = []
        blocks = base = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for place in range(self.trees):
                before = blocks
                if place:
                    again = place % _CHAIN == 0
                    source, since = (base, 0) if again else (blocks, place - 1)
                    newer = [(trees[i], self.weight(i)) for i in range(since, place)]
                    blocks = source.map(_updater(newer)).persist(StorageLevel.MEMORY_AND_DISK)
                trees.append(self.tree(lambda add, nodes: self.collected(blocks, add, nodes), residual=place > 0))
                if not place:
                    ready()
                elif before is not base:
                    before.unpersist()
        finally:
            blocks.unpersist()
            base.unpersist()
        return trees

    def tree(self, sums: Callable[[Callable, int], np.ndarray], residual: bool) -> Tree:
        """Level by level, each level in as many passes as the sums of its nodes need."""
        group = max(1, _GROUP // (8 * math.prod(self.shape)))
        tree, open_nodes = Tree(), [0]
        while open_nodes:
            made = []
            for i in range(0, len(open_nodes), group):
                some = open_nodes[i : i + group]
                found = sums(_adder(tree, some, self.shape, residual, self.classes), len(some))
                for node, each in zip(some, found):
                    made += _split(tree, node, each, self.sizes, self.depth, self.least, self.gained)
            open_nodes = made
        return tree

    def total(self, found: Iterable[tuple[int, np.ndarray]], nodes: int) -> np.ndarray:
        total = np.zeros((nodes, *self.shape))
        for node, sums in found:
            total[node] += sums
        return total

    def collected(self, blocks: RDD, add: Callable, nodes: int) -> np.ndarray:
        """The tasks' sums of each node; many large ones are added up before they reach the driver."""
        found, tasks = blocks.mapPartitions(add), blocks.getNumPartitions()
        if tasks * nodes * 8 * math.prod(self.shape) > _COLLECTED:
            found = found.reduceByKey(np.add, min(tasks, nodes))
        return self.total(found.collect(), nodes)


def _updater(trees: list[tuple[Tree, float]]) -> Callable[[Block], Block]:
    def update(block: Block) -> Block:
        bins, n, s, q, f = block
        for tree, weight in trees:
            f = f + weight * tree.values()[tree.place(bins)]
        return bins, n, s, q, f

    return update


def _adder(tree: Tree, nodes: list[int], shape: tuple[int, int, int], residual: bool, classes: bool) -> Callable:
    """Adds up a task's cells: of each node, feature and bin the rows, the sum and the sum of squares."""
    _, features, width = shape

    def add(blocks: Iterable[Block]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros((3, features, len(nodes) * width))
        slot = np.full(max(len(tree.feature), 1), -1)
        slot[nodes] = np.arange(len(nodes))
        for bins, n, s, q, f in blocks:
            if residual:
                s, q = _targets(n, s, q, f, classes)
            start = slot[tree.place(bins)] if tree.feature else np.zeros(len(n), np.int64)
            if (start < 0).any():
                inside = np.flatnonzero(start >= 0)
                start, bins, n, s, q = start[inside], bins[:, inside], n[inside], s[inside], q[inside]
            start = start * width
            for i in range(features):
                at = start + bins[i]
                for j, values in enumerate((n, s, q)):
                    total[j, i] += np.bincount(at, values, minlength=len(nodes) * width)
        yield from enumerate(total.reshape(3, features, len(nodes), width).transpose(2, 0, 1, 3))

    return add


def _split(
    tree: Tree, node: int, sums: np.ndarray, sizes: list[int], depth: int, least: int, gained: float
) -> list[int]:
    """Splits the node where most is gained, as Spark chooses; returns the children that may be split."""
    below = np.cumsum(sums, axis=2)
    whole = below[:, np.arange(len(sizes)), sizes][:, :, None]
    above = whole - below
    if not tree.feature:
        # The root's sums are those of the first candidate's sides.
        at = next((i for i, n in enumerate(sizes) if n), 0)
        tree.add(tuple((below[:, at, 0] + above[:, at, 0]).tolist()), 0)
    n, s, q = below
    m, t, r = above
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(n > 0, (q - s * s / n) / n, 0.0)
        right = np.where(m > 0, (r - t * t / m) / m, 0.0)
        gain = tree.impurity[node] - n / (n + m) * left - m / (n + m) * right
    allowed = np.arange(sums.shape[2]) < np.array(sizes)[:, None]
    allowed &= (n >= least) & (m >= least) & (gain >= gained)
    if not allowed.any():
        tree.impurity[node] = -1.0  # as Spark marks a node without a valid split
        return []
    feature, last = np.unravel_index(np.where(allowed, gain, -np.inf).argmax(), gain.shape)
    best = gain[feature, last]
    if best <= 0:
        return []
    level = tree.level[node] + 1
    children = [
        tree.add(tuple(side[:, feature, last].tolist()), level) for side in (below, above)
    ]
    tree.feature[node], tree.bin[node], tree.left[node] = int(feature), int(last), children[0]
    tree.gain[node] = float(best)
    return [c for c in children if level < depth and abs(tree.impurity[c]) >= _PURE]
