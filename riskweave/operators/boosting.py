"""The boosted trees of M13 for tables whose rows Spark ML cannot hold.

Spark ML keeps every row as objects of some 200 bytes, and reads what does not
fit in memory from disk for each of its 800 tree levels. ``CompactGBT`` is the
same estimator with the same parameters and the same fit (``GBTClassifier``:
bins, row samples, feature subsets, gains and leaves), on blocks of rows with a
byte a binned value, which stay in memory six times longer. A level is
one pass: each task adds up its rows' statistics by node, feature and bin, and
only these sums (some 130 KB a task) reach the driver. Samples and subsets come
from the same random numbers, so the trees are those of Spark ML, but for
splits of equal gain, which both choose by the rounding of sums.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; cells of a set of features that are counted together; lanes
#: in which random numbers are drawn.
BLOCK_ROWS, CELLS, LANES = 1 << 16, 1024, 4096
EPSILON = 2.0 ** -52
_64 = (1 << 64) - 1


# -- Spark's random numbers --------------------------------------------------------

def hash_seed(seed: int) -> int:
    """The first state of Spark's XORShiftRandom: MurmurHash3 of the seed's bytes."""
    def murmur(h: int) -> int:
        raw = (seed & _64).to_bytes(8, "big")
        for at in (0, 4):
            k = int.from_bytes(raw[at:at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            k = (k << 15 | k >> 17) & 0xFFFFFFFF
            h ^= k * 0x1B873593 & 0xFFFFFFFF
            h = (h << 13 | h >> 19) & 0xFFFFFFFF
            h = h * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16
    low = murmur(0x3C074A61)
    return murmur(low) << 32 | low


def _step(x):
    x = x ^ (x << np.uint64(21))
    x = x ^ (x >> np.uint64(35))
    return x ^ (x << np.uint64(4))


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 64 bits (the images of its unit vectors) applied to states."""
    out = np.zeros_like(x)
    for i in range(64):
        out ^= columns[i] * (x >> np.uint64(i) & np.uint64(1))
    return out


@lru_cache(maxsize=64)
def _jump(steps: int) -> np.ndarray:
    """The map of ``steps`` steps."""
    power, out = _step(np.uint64(1) << np.arange(64, dtype=np.uint64)), np.uint64(1) << np.arange(64, dtype=np.uint64)
    while steps:
        if steps & 1:
            out = _apply(power, out)
        power, steps = _apply(power, power), steps >> 1
    return out


def uniforms(seed: int, n: int) -> np.ndarray:
    """The first ``n`` values of ``nextDouble``, in lanes that each start where
    the one before ends."""
    lanes = min(LANES, max(1, n // 64))
    each = -(-n // lanes)
    x, ahead = np.array([hash_seed(seed)], np.uint64), _jump(2 * each)
    while len(x) < lanes:
        x, ahead = np.concatenate([x, _apply(ahead, x)]), _apply(ahead, ahead)
    x = x[:lanes]
    out = np.empty((each, lanes))
    for k in range(each):
        high = _step(x)
        x = _step(high)
        out[k] = ((high & np.uint64((1 << 26) - 1)) << np.uint64(27)) + (x & np.uint64((1 << 27) - 1))
    return (out.T.ravel()[:n]) * 2.0 ** -53


class JavaRandom:
    """``java.util.Random``, as far as the choice of features needs it."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next32(self) -> int:
        self.state = self.state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        x = self.state >> 16
        return x - (1 << 32) if x >> 31 else x

    def next_long(self) -> int:
        return (self._next32() << 32) + self._next32()


def feature_subset(n: int, k: int, seed: int) -> list[int]:
    """``k`` of ``n`` features by reservoir sampling, in the reservoir's order."""
    chosen = list(range(k))
    for i, u in enumerate(uniforms(seed, n - k).tolist(), k):
        at = int(u * (i + 1))
        if at < k:
            chosen[at] = i
    return chosen


# -- what tasks do ---------------------------------------------------------------------

def feature_sets(bins: list[int]) -> list[list[int]]:
    """Features that are counted together: their bins make CELLS cells at most."""
    sets, sizes = [], []
    for f in sorted(range(len(bins)), key=lambda f: (-bins[f], f)):
        at = next((i for i, s in enumerate(sizes) if s * bins[f] <= CELLS), None)
        if at is None:
            sets.append([f])
            sizes.append(bins[f])
        else:
            sets[at].append(f)
            sizes[at] *= bins[f]
    return sets


class Tree:
    """A tree being grown: by heap index (root 1) the feature and the last bin
    that goes left (-1: no split), and the prediction."""

    def __init__(self, depth: int):
        self.feature, self.last = np.zeros(2 << depth, np.int64), np.full(2 << depth, -1, np.int64)
        self.value, self.depth = np.zeros(2 << depth), depth

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row of ``bins`` (features x rows)."""
        at = np.ones(bins.shape[1], np.min_scalar_type(len(self.last)))
        for node in np.flatnonzero(self.last >= 0).tolist():  # parents come first
            at += (at == node) * (bins[self.feature[node]] > self.last[node]).astype(at.dtype) + (at == node) * at.dtype.type(node)
        return at


def _rows(block):
    """(bins, labels of -1 and 1, weights) of a block."""
    n, bins, label, weight = block
    return np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(label, np.float32).astype(float), np.frombuffer(weight, float)


def _targets(label: np.ndarray, state) -> tuple[np.ndarray, np.ndarray]:
    """What a tree is fitted to, and whether a row is in its sample."""
    before, drawn = state
    drawn = np.unpackbits(np.frombuffer(drawn, np.uint8), count=len(label)).view(bool)
    if before is None:  # the first tree
        return label, drawn
    with np.errstate(over="ignore"):
        return 4.0 * label / (1.0 + np.exp(2.0 * label * np.frombuffer(before, float))), drawn


def sums(pairs, tree: Tree, active: list[int], n_bins: list[int]) -> np.ndarray:
    """(node, feature, bin, statistic) of a partition's rows: weight, weighted
    target, weighted square, rows."""
    slot = np.full(len(tree.last), len(active), np.int64)
    slot[active] = np.arange(len(active))
    groups = feature_sets(n_bins)
    total = [np.zeros((4, (len(active) + 1) * int(np.prod([n_bins[f] for f in g])))) for g in groups]
    for block, state in pairs:
        bins, label, weight = _rows(block)
        target, drawn = _targets(label, state)
        node = np.where(drawn, slot[tree.nodes(bins)], len(active))
        first = weight * target
        by = (weight, first, first * target, None)
        for g, out in zip(groups, total):
            cell = node
            for f in g:
                cell = cell * n_bins[f] + bins[f]
            for k in range(4):
                out[k] += np.bincount(cell, by[k], out.shape[1])
    result = np.zeros((len(active), len(n_bins), max(n_bins), 4))
    for g, out in zip(groups, total):
        shaped = out.reshape(4, len(active) + 1, *[n_bins[f] for f in g])[:, :-1]
        for k, f in enumerate(g):
            others = tuple(2 + j for j in range(len(g)) if j != k)
            result[:, f, :n_bins[f]] = np.moveaxis(shaped.sum(axis=others) if others else shaped, 0, -1)
    return result


def _drawn(sizes: list[int], seed: int, rate: float) -> list[bytes]:
    """The sample's bits of a partition's blocks."""
    inside = uniforms(seed, sum(sizes)) < rate if rate < 1.0 else np.ones(sum(sizes), bool)
    ends = np.cumsum([0, *sizes])
    return [np.packbits(inside[a:b]).tobytes() for a, b in zip(ends, ends[1:])]


# -- the fit ---------------------------------------------------------------------------

def best_split(stats: np.ndarray, subset: list[int], n_bins: list[int], impurity: float | None, least: tuple[int, float, float]):
    """(gain, feature, last bin of the left side, statistics of the node, left
    and right) of a node; None where no feature can be split, gain -inf where
    every split leaves too few rows or gains too little. Of equal gains the
    first in the order of the subset and the bins."""
    best = None
    for f in subset:
        if n_bins[f] < 2:
            continue
        upto = np.cumsum(stats[f, :n_bins[f]], axis=0)
        left, right = upto[:-1], upto[-1] - upto[:-1]
        if impurity is None:
            impurity = variance(upto[-1])
        weight = left[:, 0] + right[:, 0]
        with np.errstate(all="ignore"):
            gain = impurity - left[:, 0] / weight * variance(left) - right[:, 0] / weight * variance(right)
        few = (np.minimum(left[:, 3], right[:, 3]) < least[0]) | (np.minimum(left[:, 0], right[:, 0]) < least[1])
        gain = np.where(few | ~(gain >= least[2]), -np.inf, gain)
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0]:
            best = (float(gain[k]), f, k, upto[-1], left[k], right[k])
    return best


def variance(s: np.ndarray):
    """The weighted variance of statistics (weight, sum, sum of squares, rows)."""
    with np.errstate(all="ignore"):
        return np.where(s[..., 0] == 0, 0.0, (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0])


class CompactGBT(GBTClassifier):
    """``GBTClassifier`` for binary labels, the logistic loss and continuous
    features, without a validation column."""

    def _fit_java(self, dataset: DataFrame):
        if self.getMaxBins() > 256:
            raise ValueError("a binned value is one byte: maxBins must be 256 at most")
        self._transfer_params_to_java()
        jvm, spark = dataset.sparkSession._jvm, dataset.sparkSession
        splits, subset_size, n = _splits(self, dataset)
        n_bins = [len(s) + 1 for s in splits]
        thresholds = [np.array(s) for s in splits]
        seed, rate, depth = self.getSeed(), self.getSubsamplingRate(), self.getMaxDepth()

        def blocks(batches):
            held, count = [], 0

            def block():
                x = np.concatenate([h[0] for h in held], axis=1)
                return pa.RecordBatch.from_pydict({"n": pa.array([x.shape[1]], pa.int32()), "bins": pa.array([x.tobytes()], pa.binary()), **{
                    name: pa.array([np.concatenate([h[k] for h in held]).tobytes()], pa.binary()) for k, name in ((1, "label"), (2, "weight"))}})

            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                held.append((np.stack([np.searchsorted(t, x[:, f]).astype(np.uint8) for f, t in enumerate(thresholds)]),
                             (np.asarray(batch.column(1)) * 2 - 1).astype(np.float32), np.asarray(batch.column(2))))
                count += batch.num_rows
                if count >= BLOCK_ROWS:
                    yield block()
                    held, count = [], 0
            if held:
                yield block()

        weight = F.col(self.getWeightCol()) if self.isDefined("weightCol") and self.getWeightCol() else F.lit(1.0)
        one = BatchedSerializer(CPickleSerializer(), 1)  # a block is read alone, and pairs with its state
        data = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"),
                              weight.cast("double").alias("w")) \
            .mapInArrow(blocks, "n int, bins binary, label binary, weight binary").rdd \
            .map(lambda r: (r[0], bytes(r[1]), bytes(r[2]), bytes(r[3])))._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK)

        def begin(index, part):
            return zip([None] * len(held := [b[0] for b in part]), _drawn(held, seed + index + 1, rate))

        def moved(tree: Tree, step: float, m: int):
            def update(index, part):
                sizes, after = [], []
                for block, (before, _) in part:
                    bins, _, _ = _rows(block)
                    value = tree.value[tree.nodes(bins)] * step
                    after.append((value if before is None else np.frombuffer(before, float) + value).tobytes())
                    sizes.append(block[0])
                return zip(after, _drawn(sizes, seed + m + index + 1, rate))
            return update

        least = (self.getMinInstancesPerNode(), self.getMinWeightFractionPerNode() * n[1], self.getMinInfoGain())
        state, trees, old = data.mapPartitionsWithIndex(begin)._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK), [], []
        try:
            for m in range(self.getMaxIter()):
                both = data.zip(state)
                tree, found, random = Tree(depth), {}, JavaRandom(seed + m)
                stack, known = [1], {}
                while stack:
                    active, stack = stack, []
                    subsets = [feature_subset(len(n_bins), subset_size, random.next_long()) if subset_size < len(n_bins) else list(range(len(n_bins))) for _ in active]
                    stats = sum(both.mapPartitions(lambda part, t=tree, a=active: [sums(part, t, a, n_bins)]).collect())
                    for rdd in old:  # the states before this one were needed for its first pass
                        rdd.unpersist()
                    old = []
                    for node, own, subset in zip(active, stats, subsets):
                        best = best_split(own, subset, n_bins, known.get(node, (None,))[0], least)
                        if node == 1:
                            root = own[0, :n_bins[0]].sum(axis=0) if best is None else best[3]
                            known[1] = (float(variance(root)), root)
                        if best is None or not best[0] > 0 or node >> depth:
                            known[node] = (*known[node][:2], best is not None and best[0] > -np.inf)
                            continue
                        gain, f, k, _, left, right = best
                        found[node] = (gain, f, k)
                        tree.feature[node], tree.last[node] = f, k
                        for child, s in ((2 * node, left), (2 * node + 1, right)):
                            known[child] = (float(variance(s)), s)
                            if not (child >> depth or abs(known[child][0]) < EPSILON):
                                stack.insert(0, child)
                for node, (_, s, *_) in known.items():
                    tree.value[node] = s[1] / s[0] if s[0] else 0.0
                trees.append(_java_tree(jvm, spark.sparkContext, tree, found, known, splits, len(n_bins)))
                if m + 1 < self.getMaxIter():
                    old = [state]
                    state = both.mapPartitionsWithIndex(moved(tree, self.getStepSize() if m else 1.0, m + 1))._reserialize(one).persist(StorageLevel.MEMORY_AND_DISK)
                    if self.getCheckpointInterval() > 0 and (m + 1) % self.getCheckpointInterval() == 0 and spark.sparkContext.getCheckpointDir():
                        state.checkpoint()
        finally:
            for rdd in (data, state, *old):
                rdd.unpersist()
        weights = [1.0, *[self.getStepSize()] * (len(trees) - 1)]
        gateway = spark.sparkContext._gateway
        all_trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
        all_weights = gateway.new_array(jvm.double, len(trees))
        for i, (t, w) in enumerate(zip(trees, weights)):
            all_trees[i], all_weights[i] = t, w
        model = jvm.org.apache.spark.ml.classification.GBTClassificationModel(self.uid, all_trees, all_weights, len(n_bins))
        return self._java_obj.copyValues(model.setParent(self._java_obj), jvm.org.apache.spark.ml.param.ParamMap())


def _splits(estimator: CompactGBT, dataset: DataFrame):
    """(thresholds of every feature, features a node, (rows, their weight)),
    found by Spark ML's own step."""
    jvm = dataset.sparkSession._jvm
    tree, config = jvm.org.apache.spark.ml.tree.impl, jvm.org.apache.spark.mllib.tree.configuration

    def single(package, name):  # of a Scala object
        return getattr(getattr(package, f"{name}$"), "MODULE$")

    rows = single(jvm.org.apache.spark.ml.util, "DatasetUtils").extractInstances(estimator._java_obj, dataset._jdf, jvm.scala.Some(2))
    strategy = estimator._java_obj.getOldBoostingStrategy(single(jvm.scala.collection.immutable, "Map$EmptyMap"), config.Algo.Classification()).treeStrategy()
    strategy.setAlgo(config.Algo.Regression())
    strategy.setImpurity(single(jvm.org.apache.spark.mllib.tree.impurity, "Variance"))
    meta = single(tree, "DecisionTreeMetadata").buildMetadata(rows, strategy, 1, estimator.getFeatureSubsetStrategy())
    found = single(tree, "RandomForest").findSplits(rows, meta, estimator.getSeed())
    return [[s.threshold() for s in of] for of in found], meta.numFeaturesPerNode(), (meta.numExamples(), meta.weightedNumExamples())


def _java_tree(jvm, sc, tree: Tree, found: dict, known: dict, splits: list[list[float]], n_features: int):
    """The tree as Spark ML's model; two leaves of one prediction are one."""
    ml, impurity = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity

    def calculator(node):
        stats = sc._gateway.new_array(jvm.double, 3)
        for i in range(3):
            stats[i] = float(known[node][1][i])
        return impurity.VarianceCalculator(stats, int(known[node][1][3]))

    def build(node):
        """(model node, its prediction if it is a leaf)"""
        value = float(tree.value[node])
        if node in found:
            gain, f, k = found[node]
            (left, a), (right, b) = build(2 * node), build(2 * node + 1)
            if a is None or a != b:
                return ml.InternalNode(value, known[node][0], gain, left, right, ml.ContinuousSplit(f, splits[f][k]), calculator(node)), None
            value = a
        valid = node in found or len(known[node]) < 3 or known[node][2]
        return ml.LeafNode(value, known[node][0] if valid else -1.0, calculator(node)), value

    return jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel("dtr-compact", build(1)[0], n_features)
