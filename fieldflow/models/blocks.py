"""Boosted trees grown on blocks of binned rows: the fit of Spark ML's GBTClassifier and GBTRegressor for many rows.

The method is Spark ML's: quantile bins, variance splits level by level, a share of the rows per round and of the
features per node, pseudo-residuals of the same losses, the same pruning; the result is Spark ML's own model. What differs
is how rows are held: a block keeps two features' bins in one 16-bit code, and a level is one pass of array sums over
all blocks, in which only the smaller child of each split is counted and the other is what its parent has left. Rows and
features are drawn by seed, round and block or node, in another order than Spark ML draws them.

The driver gets one histogram per task and level, at most 2^(depth - 2) nodes x features x bins.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldflow.session import cut_lineage, scratch

#: Codes per feature in a pair, the most bins a feature may have.
BINS = 32
BLOCK_ROWS = 131_072
#: Rows of a task of a pass.
TASK_ROWS = 8_000_000
#: Rounds after which margins are made afresh from the written blocks, so that no lineage grows longer.
LINEAGE_ROUNDS = 25
EPSILON = 2.0**-52

BLOCKS_SCHEMA = "part int, number int, n int, least double, codes binary, y binary, w binary"
NODES_SCHEMA = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


@dataclass
class Tree:
    """A tree as arrays over a heap of nodes: place of the feature among those held (-1 at leaves), last bin on the left, prediction, gain, (count, weight, sum, squares)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    stats: np.ndarray
    weight: float

    @classmethod
    def empty(cls, depth: int, weight: float) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size), np.full(size, -1.0), np.zeros((size, 4)), weight)


def bin_edges(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds that cut ``values`` into at most ``bins`` parts of about equal weight, halfway between neighbours."""
    distinct, at = np.unique(values, return_inverse=True)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    counts = np.bincount(at, weights)
    stride = counts.sum() / bins
    edges, seen, target = [], counts[0], stride
    for i in range(1, len(distinct)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            edges.append((distinct[i - 1] + distinct[i]) / 2)
            target += stride
    return np.array(edges)


def features_per_node(strategy: str, n: int) -> int:
    named = {"auto": n, "all": n, "onethird": math.ceil(n / 3), "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), n) if strategy.isdigit() else math.ceil(float(strategy) * n)


def pack(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bins of the columns, two to a code: one row of codes per pair of features."""
    codes = np.zeros(((len(columns) + 1) // 2, len(columns[0])), np.uint16)
    for i, (values, cuts) in enumerate(zip(columns, edges, strict=True)):
        found = np.searchsorted(cuts, values).astype(np.uint16)
        codes[i // 2] |= found << 5 if i % 2 == 0 else found
    return codes


def compact(values: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(numbers, table) where a block has few distinct values, else (values, None)."""
    table, numbers = np.unique(values, return_inverse=True)
    return (numbers.astype(np.uint8), table) if len(table) <= 256 else (values, None)


def expand(held: tuple[np.ndarray, np.ndarray | None], rows: np.ndarray | None = None) -> np.ndarray:
    numbers, table = held
    found = numbers if rows is None else numbers.take(rows)
    return found if table is None else table.take(found)


def rows_of_nodes(codes: np.ndarray, tree: Tree, rows: np.ndarray, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(node, its rows) of the ``wanted`` nodes and those above them alone, or of all leaves."""
    on_the_way = wanted if wanted is None else {node >> up for node in (n + 1 for n in wanted) for up in range(node.bit_length())}
    open_nodes = [(0, rows)]
    while open_nodes:
        node, rows = open_nodes.pop()
        feature = tree.feature[node]
        if feature < 0 if wanted is None else node in wanted:
            yield node, rows
            continue
        cut, code = tree.cut[node], codes[feature // 2].take(rows)
        left = code <= (cut << 5 | 31) if feature % 2 == 0 else (code & 31) <= cut
        for child in (2 * node + 2, 2 * node + 1):
            if on_the_way is None or child + 1 in on_the_way:
                open_nodes.append((child, rows.take(np.flatnonzero(left if child % 2 else ~left))))


def residuals(y: np.ndarray, margin: np.ndarray | None, logistic: bool) -> np.ndarray:
    """What the next tree learns: the labels themselves at first (``margin`` is None), then the loss's downhill direction."""
    if margin is None:
        return y
    if not logistic:
        return 2 * (y - margin)
    with np.errstate(over="ignore"):
        return 4 * y / (1 + np.exp(2 * y * margin))


def drawn_rows(key: int, n: int, number: int, rate: float, seed: int) -> np.ndarray:
    """The rows of a block that a round learns from."""
    if rate >= 1:
        return np.arange(n)
    draw = np.random.Generator(np.random.SFC64([seed % 2**63, number, key]))
    return np.flatnonzero(draw.random(n, np.float32) < rate)


@dataclass(frozen=True)
class Settings:
    features: int
    logistic: bool
    rate: float
    seed: int


def sums_by(place: np.ndarray, size: int, g: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    """Count, weight, weighted sum and weighted squares of what rows learn, by their place."""
    weighted, sums = g if w is None else g * w, np.zeros((size, 4))
    sums[:, 0] = np.bincount(place, minlength=size)
    sums[:, 1] = sums[:, 0] if w is None else np.bincount(place, w, size)
    sums[:, 2] = np.bincount(place, weighted, size)
    sums[:, 3] = np.bincount(place, weighted * g, size)
    return sums


def after_tree(block, tree: Tree, number: int, s: Settings):
    """The block with the tree's share added to its margins, and the sums of the leaves that lie at full depth."""
    key, codes, y, w, margin, _ = block
    n, first = codes.shape[1], len(tree.feature) // 2
    at = np.empty(n, np.int64)
    for node, rows in rows_of_nodes(codes, tree, np.arange(n)):
        at[rows] = node
    drawn = drawn_rows(key, n, number, s.rate, s.seed)
    drawn = drawn.take(np.flatnonzero(at.take(drawn) >= first))
    learned = residuals(expand(y, drawn), None if margin is None else margin.take(drawn), s.logistic)
    sums = sums_by(at.take(drawn) - first, first + 1, learned, None if w is None else expand(w, drawn))
    gained = (tree.weight * tree.value).take(at)
    return key, codes, y, w, gained if margin is None else margin + gained, sums


def count_level(blocks, tree: Tree, wanted: list[int], number: int, s: Settings):
    """Over some blocks: histograms (node, weight or weighted sum, feature, bin) and sums of the ``wanted`` nodes, sums of the last tree's leaves."""
    pairs, cells, place = (s.features + 1) // 2, BINS * BINS, {node: i for i, node in enumerate(wanted)}
    joint, sums, leaves = None, np.zeros((len(wanted), 4)), 0
    for key, codes, y, w, margin, ended in blocks:
        found = [np.empty(0, np.int64)] * len(wanted)
        for node, rows in rows_of_nodes(codes, tree, drawn_rows(key, codes.shape[1], number, s.rate, s.seed), set(wanted)):
            found[place[node]] = rows
        rows = np.concatenate(found)
        owner = np.repeat(np.arange(len(wanted)), [len(r) for r in found])
        learned = residuals(expand(y, rows), None if margin is None else margin.take(rows), s.logistic)
        weights = None if w is None else expand(w, rows)
        sums += sums_by(owner, len(wanted), learned, weights)
        leaves = leaves + (0 if ended is None else ended)
        if joint is None:
            joint = np.zeros((pairs, 2, len(wanted) * cells))
        base, weighted = owner * cells, learned if weights is None else learned * weights
        for pair in range(pairs):
            cell = base + codes[pair].take(rows)
            joint[pair, 0] += np.bincount(cell, weights, len(wanted) * cells)
            joint[pair, 1] += np.bincount(cell, weighted, len(wanted) * cells)
    if joint is None:
        return None
    table = joint.reshape(pairs, 2, len(wanted), BINS, BINS)
    one = np.stack([table.sum(4), table.sum(3)], axis=1).reshape(2 * pairs, 2, len(wanted), BINS)
    return one[: s.features].transpose(2, 1, 0, 3), sums, leaves


def best_split(counted: np.ndarray, usable: list[int], cuts: list[int], least: float) -> tuple[float, int, int] | None:
    """(gain, feature, last bin on the left) of the split that takes most off the variance; the first one wins a tie.

    ``least`` is the smallest weight of a row: a side of less holds none.
    """
    best = None
    for f in usable:
        if not cuts[f]:
            continue
        left, total = np.cumsum(counted[:, f], axis=1)[:, : cuts[f]], counted[:, f].sum(1)
        right = total[:, None] - left
        valid = (left[0] > least / 2) & (right[0] > least / 2)
        if not valid.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            score = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - total[1] ** 2 / total[0]
        gain = np.where(valid, score / total[0], -np.inf)
        at = int(np.argmax(gain))
        if best is None or gain[at] > best[0]:
            best = float(gain[at]), f, at
    return best if best is not None and best[0] > 0 else None


def alike(stats: np.ndarray) -> bool:
    """Whether a node's rows all learn the same, up to rounding: it stays whole."""
    return variance(stats) < max(EPSILON, 1e-12 * stats[3] / stats[1])


def variance(stats: np.ndarray) -> float:
    _, w, t, squares = stats
    return float((squares - t * t / w) / w) if w else 0.0


def handles(booster) -> bool:
    """Whether the booster's settings are ones that blocks know; all others stay with Spark ML."""
    plain = booster.getMinInstancesPerNode() == 1 and booster.getMinInfoGain() == 0 and booster.getMinWeightFractionPerNode() == 0
    unset = not any(booster.hasParam(p) and booster.isSet(p) for p in ("validationIndicatorCol", "thresholds", "checkpointInterval"))
    return plain and unset and booster.getMaxBins() == BINS and booster.getLossType() in ("logistic", "squared")


class BlockFit:
    """A fit that goes on: ``model(n)`` grows the trees still missing for ``n`` rounds, a model of fewer is a cut of what there is."""

    def __init__(self, booster, train: DataFrame, names: list[str]):
        self.booster, self.names, self.spark = booster, names, train.sparkSession
        self.logistic = isinstance(booster, GBTClassifier)
        self.depth, self.trees = booster.getMaxDepth(), []
        y = F.col(booster.getLabelCol()).cast("double")
        weighted = booster.isSet("weightCol")
        columns = [*[F.col(c).cast("double").alias(c) for c in names], y.alias("_y")]
        if weighted:
            columns.append(F.col(booster.getWeightCol()).cast("double").alias("_w"))
        rows = train.select(*columns)
        self.edges = self._edges(rows, weighted)
        # Only features that can split are held; one with few bins shares a code with one of many, so that sums spread over cells.
        cut = sorted((f for f in range(len(names)) if len(self.edges[f])), key=lambda f: len(self.edges[f]))
        half = len(cut) // 2
        self.held = [f for two in itertools.zip_longest(reversed(cut[half:]), cut[:half]) for f in two if f is not None] or [0]
        self.settings = Settings(len(self.held), self.logistic, booster.getSubsamplingRate(), booster.getSeed())
        self._cut(rows)

    def _edges(self, rows: DataFrame, weighted: bool) -> list[np.ndarray]:
        """Bin edges from as many rows as Spark ML takes for them."""
        total = rows.count()
        share = min(1.0, max(BINS * BINS, 10_000) / max(total, 1))
        some = rows.sample(False, share, self.booster.getSeed() % 2**63) if share < 1 else rows
        found = some.toArrow()
        weights = found["_w"].to_numpy() if weighted else np.ones(found.num_rows)
        return [bin_edges(found[c].to_numpy(), weights) for c in self.names]

    def _cut(self, rows: DataFrame) -> None:
        names, logistic = [self.names[f] for f in self.held], self.logistic
        edges = [self.edges[f] for f in self.held]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, part, numbers = [], 0, TaskContext.get().partitionId(), itertools.count()

            def block() -> pa.RecordBatch:
                table = pa.Table.from_batches(held)
                for c in table.column_names:
                    values = table[c].to_numpy()
                    if table[c].null_count or np.isnan(values).any():
                        raise ValueError(f"{c} holds null or NaN in rows to learn from")
                y = table["_y"].to_numpy()
                if logistic:
                    if not np.isin(y, (0.0, 1.0)).all():
                        raise ValueError("a classifier's labels are 0 and 1")
                    y = 2 * y - 1
                w, least = None, 1.0
                if "_w" in table.column_names:
                    w, least = table["_w"].to_numpy(), table["_w"].to_numpy().min()
                    if least <= 0:
                        raise ValueError("a row to learn from has a weight above 0")
                    w = w.tobytes()
                codes = pack([table[c].to_numpy() for c in names], edges)
                numbered = [pa.array([v], pa.int32()) for v in (part, next(numbers), len(y))]
                return pa.RecordBatch.from_arrays(
                    [*numbered, pa.array([least]), *[pa.array([v], pa.binary()) for v in (codes.tobytes(), y.tobytes(), w)]],
                    ["part", "number", "n", "least", "codes", "y", "w"],
                )

            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    held.append(batch.slice(at, BLOCK_ROWS - n))
                    at, n = at + held[-1].num_rows, n + held[-1].num_rows
                    if n == BLOCK_ROWS:
                        yield block()
                        held, n = [], 0
            if n:
                yield block()

        written = cut_lineage(rows.mapInArrow(cut, BLOCKS_SCHEMA), "blocks")
        listed = written.select("part", "number", "n", "least").collect()  # one short row per block
        place = {key: i for i, key in enumerate(sorted((r.part, r.number) for r in listed))}
        self.least = min((r.least for r in listed), default=1.0)
        slots = self.spark.sparkContext.defaultParallelism
        tasks = slots * -(-sum(r.n for r in listed) // (slots * TASK_ROWS))
        self.parts = max(1, min(tasks, len(listed)))
        pairs = (len(names) + 1) // 2

        def unpack(r):
            key, numbers = place[r.part, r.number], np.frombuffer
            w = None if r.w is None else compact(numbers(r.w))
            return key, (key, numbers(r.codes, np.uint16).reshape(pairs, -1), compact(numbers(r.y)), w, None, None)

        # Whole blocks are dealt in turn, so that tasks are even whatever files they were written to.
        self.base = written.rdd.map(unpack).partitionBy(self.parts, int).values()
        self.state, self.done, self.fresh = self.base.map(lambda block: block).persist(StorageLevel.MEMORY_AND_DISK), None, 0

    def _pass(self, tree: Tree, wanted: list[int], number: int):
        s = self.settings

        def run(blocks):
            found = count_level(blocks, tree, wanted, number, s)
            return [] if found is None else [found]

        add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
        tasks = self.state.mapPartitions(run)
        if self.parts > 64:
            return tasks.treeReduce(add)
        found = tasks.collect()
        total = found[0]
        for other in found[1:]:
            total = add(total, other)
        return total

    def _advance(self) -> None:
        """Margins with the last tree; from time to time afresh from the written blocks, so that lineage stays short."""
        s, trees, source = self.settings, self.trees[-1:], self.state
        if len(self.trees) - self.fresh >= LINEAGE_ROUNDS:
            trees, source, self.fresh = list(self.trees), self.base, len(self.trees)
        first = len(self.trees) - len(trees)

        def add(block):
            for i, tree in enumerate(trees, first):
                block = after_tree(block, tree, i, s)
            return block

        self.done, self.state = self.state, source.map(add).persist(StorageLevel.MEMORY_AND_DISK)

    def _grow(self) -> None:
        number = len(self.trees)
        tree = Tree.empty(self.depth, self.booster.getStepSize() if number else 1.0)
        n = len(self.names)
        take = features_per_node(self.booster.getFeatureSubsetStrategy(), n)
        if number:
            self._advance()
        place, cuts = {f: i for i, f in enumerate(self.held)}, [len(self.edges[f]) for f in self.held]
        wanted, counted = [0], {}
        for level in range(self.depth):
            found, sums, leaves = self._pass(tree, wanted, number)
            if level == 0 and number:
                self._settle(self.trees[-1], leaves)
                self.done.unpersist()
            now = {}
            for node, table, stats in zip(wanted, found, sums):
                now[node], tree.stats[node] = table, stats
                if node:
                    other, parent = node + 1 if node % 2 else node - 1, (node - 1) // 2
                    now[other], tree.stats[other] = counted[parent] - table, tree.stats[parent] - stats
            counted, wanted = now, []
            for node, table in sorted(counted.items()):
                if not node:
                    tree.value[0] = tree.stats[0, 2] / tree.stats[0, 1]
                if alike(tree.stats[node]):
                    continue
                rng = np.random.default_rng([self.settings.seed % 2**63, number, node])
                drawn = range(n) if take >= n else sorted(rng.choice(n, take, replace=False))
                split = best_split(table, [place[f] for f in drawn if f in place], cuts, self.least)
                if split is None:
                    continue
                tree.gain[node], tree.feature[node], tree.cut[node] = split
                _, f, cut = split
                left, right = table[:, f, : cut + 1].sum(1), table[:, f, cut + 1 :].sum(1)
                tree.value[2 * node + 1], tree.value[2 * node + 2] = left[1] / left[0], right[1] / right[0]
                wanted.append(2 * node + 1 if left[0] <= right[0] else 2 * node + 2)
            if not wanted:
                break
        self.trees.append(tree)

    @staticmethod
    def _settle(tree: Tree, leaves: np.ndarray) -> None:
        first = len(tree.feature) // 2
        tree.stats[first:] = leaves

    def model(self, rounds: int):
        """Spark ML's model of the first ``rounds`` trees."""
        while len(self.trees) < rounds:
            self._grow()
        last = self.trees[-1]
        if rounds == len(self.trees) and not last.stats[len(last.feature) // 2 :].any():
            s, number = self.settings, len(self.trees) - 1
            ended = self.state.map(lambda block: after_tree(block, last, number, s)[-1])
            self._settle(last, ended.treeReduce(lambda a, b: a + b))
        return self._saved(rounds)

    def _saved(self, rounds: int):
        path = scratch(self.spark, "model")
        rows = [(i, node) for i, tree in enumerate(self.trees[:rounds]) for node in self._nodes(tree)]
        self.spark.createDataFrame(rows, NODES_SCHEMA).coalesce(1).write.parquet(f"{path}/data")
        meta = lambda of, kind, **more: json.dumps(of | {"class": f"org.apache.spark.ml.{kind}", **more})
        plain = {"timestamp": 0, "sparkVersion": self.spark.version, "paramMap": {}, "defaultParamMap": {}}
        trees = [
            (i, meta(plain, "regression.DecisionTreeRegressionModel", uid=f"dtr_{uuid.uuid4().hex[:12]}"), tree.weight)
            for i, tree in enumerate(self.trees[:rounds])
        ]
        self.spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        self.booster.copy({self.booster.maxIter: rounds}).save(f"{path}/booster")
        settings = json.loads(self.spark.read.text(f"{path}/booster/metadata").first()[0])
        kind = "classification.GBTClassificationModel" if self.logistic else "regression.GBTRegressionModel"
        line = meta(settings, kind, numFeatures=len(self.names), numTrees=rounds)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return (GBTClassificationModel if self.logistic else GBTRegressionModel).load(path)

    def _nodes(self, tree: Tree) -> list[tuple]:
        """The nodes in preorder, as Spark ML stores them; sister leaves that predict alike are one leaf."""
        out = []

        def leaf_value(node: int) -> float | None:
            if tree.feature[node] < 0:
                return float(tree.value[node])
            left, right = leaf_value(2 * node + 1), leaf_value(2 * node + 2)
            return left if left == right else None

        def add(node: int) -> int:
            at, same = len(out), leaf_value(node)
            out.append(None)
            count, *sums = map(float, tree.stats[node])
            held = variance(tree.stats[node]), sums, int(count)
            if same is not None:
                out[at] = at, same, *held, -1.0, -1, -1, (-1, [], -1)
            else:
                children = add(2 * node + 1), add(2 * node + 2)
                f = self.held[tree.feature[node]]
                threshold = float(self.edges[f][tree.cut[node]])
                out[at] = at, float(tree.value[node]), *held, float(tree.gain[node]), *children, (f, [threshold], -1)
            return at

        add(0)
        return out

    def close(self) -> None:
        self.state.unpersist()
