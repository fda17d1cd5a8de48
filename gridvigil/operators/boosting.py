"""Gradient boosting of regression trees over histograms, one model for all classes.

Features are cut into bins at quantiles once; rows are stored in parts of bin codes. A pass over
the parts sums gradients and hessians of the softmax loss by (tree, node, feature, bin), merged
in each task before they are shuffled, and the splits of all nodes of all classes' trees are
chosen from these sums: a level of every tree costs one pass, whatever the number of classes.
Of two sibling nodes only the one with fewer rows is scanned; the other's sums are its parent's
less these. Trees grow level by level, or best-first: the leaf with the largest gain is split
next until the leaf budget is spent. A pass then looks ahead at the children of as many waiting
leaves as the budget may still reach, so that the order stays exact and passes stay few.

Gradients are rounded to ``GRAIN`` and summed as whole numbers: trees do not depend on the
partitioning or on repeated tasks. Scores are written to the shared folder every ``INTERVAL``
rounds and computed from there, so a lost executor costs a few rounds' predictions.
The driver holds sums of at most ``MAX_SUMS`` bytes; beyond it a level is done in several passes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from gridvigil.session import scratch_path

#: codes of a feature; the last one stands for a missing value
CODES = 256
MISSING = CODES - 1
#: rows of a part
PART = 1 << 16
#: gradients are multiples of it; sums of whole numbers do not depend on their order
GRAIN = 2.0**-20
#: rounds between two writes of the scores
INTERVAL = 8
#: bytes of sums that the driver holds
MAX_SUMS = 256 << 20
#: bytes of sums that one pass makes
MAX_PASS = 64 << 20
#: sums of a bin: gradient, hessian, rows
SUMS = 3


@dataclass(frozen=True)
class Boosting:
    """Settings; ``leaves`` set: best-first growth up to so many leaves."""

    rounds: int = 200
    depth: int = 8
    rate: float = 0.1
    leaves: int | None = None
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    bins: int = 128


@dataclass
class Tree:
    """Nodes by number, 0 the root; a leaf has feature -1. Codes up to ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node] = feature, cut, missing_left
        self.left[node], self.right[node], self.gain[node] = left, left + 1, gain
        for column, empty in zip(self.columns(), (-1, 0, False, 0, 0, 0.0, 0.0), strict=True):
            column += [empty, empty]
        return left, left + 1

    def columns(self) -> tuple[list, ...]:
        return self.feature, self.cut, self.missing_left, self.left, self.right, self.value, self.gain

    def without(self, undone: set[int]) -> Tree:
        """The tree in which the nodes of ``undone`` are leaves."""
        made = Tree()
        todo = [(0, 0)]
        while todo:
            old, new = todo.pop()
            made.value[new] = self.value[old]
            if self.feature[old] >= 0 and old not in undone:
                children = made.split(new, self.feature[old], self.cut[old], self.missing_left[old], self.gain[old])
                todo += zip((self.left[old], self.right[old]), children, strict=True)
        return made

    def n_leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of every row; ``codes`` by feature and row."""
        feature, cut, missing_left, left, right = (np.array(c) for c in self.columns()[:5])
        node = np.zeros(codes.shape[1], np.int64)
        rows = np.arange(codes.shape[1])
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            code = codes[feature[at], rows]
            to_left = np.where(code == MISSING, missing_left[at], code <= cut[at])
            node[rows] = np.where(to_left, left[at], right[at])
        return node


Round = list[Tree]


def n_trees(n_classes: int) -> int:
    """Two classes share one tree a round: the score of the second class."""
    return 1 if n_classes == 2 else n_classes


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Rows of class probabilities from rows of scores."""
    if scores.shape[1] == 1:
        second = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
        return np.concatenate([1 - second, second], axis=1)
    power = np.exp(scores - scores.max(1, keepdims=True))
    return power / power.sum(1, keepdims=True)


def add_rounds(scores: np.ndarray, rounds: list[Round], codes: np.ndarray, rate: float) -> np.ndarray:
    scores = scores.copy()
    for trees in rounds:
        for column, tree in enumerate(trees):
            scores[:, column] += rate * np.array(tree.value)[tree.nodes_of(codes)]
    return scores


def gradients(scores: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of grains, by row and tree."""
    share = probabilities(scores)
    truth = label[:, None] == np.arange(share.shape[1])
    if scores.shape[1] == 1:
        share, truth = share[:, 1:], truth[:, 1:]
        hessian = share * (1 - share)
    else:
        hessian = 2 * share * (1 - share)
    scale = weight[:, None] / GRAIN
    return np.rint((share - truth) * scale), np.rint(hessian * scale)


# --- parts ------------------------------------------------------------------------------------


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last, which are values of the feature."""
    if not 2 <= bins < CODES:
        raise ValueError(f"bins must be 2 to {CODES - 1}")
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    shares = [i / bins for i in range(1, bins)]
    found = values.approxQuantile(values.columns, shares, 1 / (8 * bins))
    return [np.unique(np.array(edges, float)) for edges in found]


def codes_of(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes by feature and row, of ``values`` by row and feature."""
    codes = np.empty((len(edges), len(values)), np.uint8)
    for i, own in enumerate(edges):
        codes[i] = np.searchsorted(own, values[:, i], side="left")
        codes[i][np.isnan(values[:, i])] = MISSING
    return codes


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def feature_array(features: Sequence[str]):
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


PARTS = "codes binary, label binary, weight binary, scores binary"


def parts_of(batch: pa.RecordBatch, n_features: int, trees: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts of a batch one by one; it holds as many as Spark sends at once."""
    for i in range(batch.num_rows):
        codes, label, weight, scores = (column[i].as_buffer() for column in batch.columns)
        yield (
            np.frombuffer(codes, np.uint8).reshape(n_features, -1),
            np.frombuffer(label, "<i4"),
            np.frombuffer(weight, "<f8"),
            np.frombuffer(scores, "<f8").reshape(-1, trees),
        )


def make_parts(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None, classes: list[str],
    edges: list[np.ndarray], base: np.ndarray,
) -> DataFrame:
    rows = df.select(
        feature_array(features).alias("x"),
        F.col(f"`{label}`").cast("string").alias("label"),
        (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("weight"),
    ).where("label IS NOT NULL")
    width = len(features)

    def part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        codes = codes_of(matrix(table.column(0).combine_chunks(), width), edges)
        number = pc.index_in(table.column(1), pa.array(classes, pa.string())).to_numpy()
        weights = table.column(2).to_numpy()
        scores = np.tile(base, (len(weights), 1))
        values = (codes, number.astype("<i4"), weights.astype("<f8"), scores.astype("<f8"))
        return pa.RecordBatch.from_arrays(
            [pa.array([v.tobytes()], pa.binary()) for v in values], names=["codes", "label", "weight", "scores"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, PART - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == PART:
                    yield part(held)
                    held, n = [], 0
        if n:
            yield part(held)

    return rows.mapInArrow(run, PARTS)


@dataclass(frozen=True)
class Parts:
    """Parts in the shared folder, and in how many tasks they are read."""

    rows: DataFrame
    n_tasks: int


def kept(parts: DataFrame) -> Parts:
    """``parts`` written to the shared folder and read again."""
    path = scratch_path(parts.sparkSession, "boosting")
    parts.write.parquet(path)
    rows = parts.sparkSession.read.schema(PARTS).parquet(path)
    return Parts(rows, rows.rdd.getNumPartitions())


# --- passes -----------------------------------------------------------------------------------


def node_sums(
    parts: Parts, since: list[Round], growing: Round, wanted: list[tuple[int, int]], n_features: int, rate: float
) -> np.ndarray:
    """Sums by wanted (tree, node), feature and code, in as many passes as ``MAX_PASS`` asks."""
    own = n_features * CODES * SUMS * 8
    step = max(1, MAX_PASS // own)
    found = [
        _pass(parts, since, growing, wanted[i : i + step], n_features, rate) for i in range(0, len(wanted), step)
    ]
    return np.concatenate(found)


def _pass(
    parts: Parts, since: list[Round], growing: Round, wanted: list[tuple[int, int]], n_features: int, rate: float
) -> np.ndarray:
    slots = [np.full(len(tree.feature), -1) for tree in growing]
    for slot, (tree, node) in enumerate(wanted):
        slots[tree][node] = slot
    shape = (len(wanted), n_features, CODES, SUMS)

    def add_part(
        total: np.ndarray, codes: np.ndarray, label: np.ndarray, weight: np.ndarray, scores: np.ndarray
    ) -> None:
        gradient, hessian = gradients(add_rounds(scores, since, codes, rate), label, weight)
        for number, tree in enumerate(growing):
            slot = slots[number][tree.nodes_of(codes)]
            rows = np.flatnonzero(slot >= 0)
            if not len(rows):
                continue
            at, g, h = slot[rows] * CODES, gradient[rows, number], hessian[rows, number]
            for f in range(n_features):
                place = at + codes[f, rows]
                size = len(wanted) * CODES
                for i, values in enumerate((g, h, None)):
                    # whole numbers below 2^53: exact as doubles
                    sums = np.bincount(place, values, minlength=size).reshape(-1, CODES)
                    total[:, f, :, i] += sums.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for part in parts_of(batch, n_features, len(growing)):
                add_part(total, *part)
                del part
            del batch  # before the next one is read
        used = [(s, f) for s in range(shape[0]) if total[s].any() for f in range(n_features)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _ in used], pa.int32()),
                pa.array([f for _, f in used], pa.int32()),
                pa.array([total[s, f].tobytes() for s, f in used], pa.binary()),
            ],
            names=["slot", "feature", "sums"],
        )

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(CODES * SUMS, np.int64)
        for value in table.column("sums"):
            total += np.frombuffer(value.as_py(), np.int64)
        return pa.table(
            {
                "slot": pa.array([key[0].as_py()], pa.int32()),
                "feature": pa.array([key[1].as_py()], pa.int32()),
                "sums": pa.array([total.tobytes()], pa.binary()),
            }
        )

    schema = "slot int, feature int, sums binary"
    sums = parts.rows.mapInArrow(run, schema)
    found = np.zeros(shape, np.int64)
    if parts.n_tasks * found.nbytes > MAX_PASS:  # else the driver adds the tasks' sums itself
        sums = sums.groupBy("slot", "feature").applyInArrow(add, schema)
    for row in sums.collect():  # at most MAX_PASS bytes
        found[row["slot"], row["feature"]] += np.frombuffer(row["sums"], np.int64).reshape(CODES, SUMS)
    return found


# --- choosing splits ----------------------------------------------------------------------------


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    #: gradient, hessian and rows of the left and the right child
    left: tuple[float, float, int]
    right: tuple[float, float, int]


def best_split(sums: np.ndarray, settings: Boosting) -> Split | None:
    """The split of the largest gain (ties: first feature, cut, missing values right)."""
    g, h, n = (sums[..., i].astype(float) * (GRAIN if i < 2 else 1) for i in range(SUMS))
    all_g, all_h, all_n = g[0].sum(), h[0].sum(), n[0].sum()

    def of(one: np.ndarray) -> np.ndarray:
        """Left sums by feature, cut, and where missing values go."""
        upto = np.cumsum(one[:, :MISSING], axis=1)
        return np.stack([upto, upto + one[:, MISSING:]], axis=2)

    left_g, left_h, left_n = of(g), of(h), of(n)
    right_g, right_h, right_n = all_g - left_g, all_h - left_h, all_n - left_n
    good = (left_n >= settings.min_rows) & (right_n >= settings.min_rows) & (left_n > 0) & (right_n > 0)
    good &= (left_h >= settings.min_hessian) & (right_h >= settings.min_hessian)
    good[..., 1] &= n[:, MISSING:] > 0
    l2 = settings.l2 + 1e-12
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain = np.where(good, gain / 2, -np.inf)
    at = int(gain.argmax())
    f, cut, missing_left = (int(x) for x in np.unravel_index(at, gain.shape))
    if not gain[f, cut, missing_left] > 1e-9:
        return None
    place = (f, cut, missing_left)
    return Split(
        float(gain[place]), f, cut, bool(missing_left),
        (float(left_g[place]), float(left_h[place]), int(left_n[place])),
        (float(right_g[place]), float(right_h[place]), int(right_n[place])),
    )


def leaf_value(gradient: float, hessian: float, settings: Boosting) -> float:
    return -gradient / (hessian + settings.l2 + 1e-12)


class Growth:
    """The trees of one round while they grow."""

    def __init__(self, parts: Parts, since: list[Round], n_trees: int, n_features: int, settings: Boosting):
        self.parts, self.since, self.n_features, self.settings = parts, since, n_features, settings
        self.trees: Round = [Tree() for _ in range(n_trees)]
        self.level = {(t, 0): 0 for t in range(n_trees)}
        #: sums of nodes whose children may be looked at, and the best split of each node
        self.sums: dict[tuple[int, int], np.ndarray] = {}
        self.best: dict[tuple[int, int], Split | None] = {}
        self.total: dict[tuple[int, int], tuple[float, float]] = {}
        self.scanned: list[tuple[int, int]] = []

    def scan(self, wanted: list[tuple[int, int]]) -> None:
        """Sums and best splits of nodes, read from the rows."""
        if not wanted:
            return
        step = max(1, MAX_PASS // (self.n_features * CODES * SUMS * 8))
        for i in range(0, len(wanted), step):
            some = wanted[i : i + step]
            found = node_sums(self.parts, self.since, self.trees, some, self.n_features, self.settings.rate)
            for node, sums in zip(some, found, strict=True):
                self.learn(node, sums)
        self.scanned += wanted

    def learn(self, node: tuple[int, int], sums: np.ndarray) -> None:
        self.best[node] = best_split(sums, self.settings)
        g, h, _ = sums[0].sum(0).tolist()
        self.total[node] = g * GRAIN, h * GRAIN
        if sum(s.nbytes for s in self.sums.values()) + sums.nbytes <= MAX_SUMS:
            self.sums[node] = sums

    def split(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        """Split a node at its best; returns its children, the one with fewer rows first."""
        t, number = node
        found = self.best[node]
        children = self.trees[t].split(number, found.feature, found.cut, found.missing_left, found.gain)
        for child, (gradient, hessian, _) in zip(children, (found.left, found.right), strict=True):
            self.trees[t].value[child] = leaf_value(gradient, hessian, self.settings)
            self.level[t, child] = self.level[node] + 1
        pair = [(t, c) for c in children]
        return pair if found.left[2] <= found.right[2] else pair[::-1]

    def look_at(self, parents: list[tuple[int, int]], children: list[list[tuple[int, int]]]) -> None:
        """Best splits of the children: the smaller is scanned, the other is what is left."""
        wanted = []
        for parent, (small, large) in zip(parents, children, strict=True):
            wanted += [small] if parent in self.sums else [small, large]
        whole = {p: self.sums.pop(p) for p in parents if p in self.sums}
        self.scan(wanted)
        for parent, (small, large) in zip(parents, children, strict=True):
            if parent not in whole:
                continue
            if small in self.sums:
                self.learn(large, whole[parent] - self.sums[small])
            else:  # no room for the smaller one's sums: the other is scanned as well
                self.scan([large])

    def roots(self) -> list[tuple[int, int]]:
        nodes = [(t, 0) for t in range(len(self.trees))]
        self.scan(nodes)
        for t, node in enumerate(nodes):
            self.trees[t].value[0] = leaf_value(*self.total[node], self.settings)
        return nodes

    def by_level(self) -> Round:
        nodes = self.roots()
        for level in range(self.settings.depth):
            parents = [n for n in nodes if self.best[n] is not None]
            for node in nodes:
                if self.best[node] is None:
                    self.sums.pop(node, None)
            children = [self.split(p) for p in parents]
            if level + 1 == self.settings.depth or not parents:
                break
            self.look_at(parents, children)
            nodes = [c for pair in children for c in pair]
        return self.trees

    def best_first(self) -> Round:
        budget = self.settings.leaves
        waiting = [[n] for n in self.roots()]
        children: dict[tuple[int, int], list[tuple[int, int]]] = {}
        leaves = [1] * len(self.trees)
        done: set[tuple[int, int]] = set()

        def may_split(node):
            return self.best.get(node) is not None and self.level[node] < self.settings.depth

        def order(node):
            return -self.best[node].gain, node

        while True:
            ahead = []
            for t, nodes in enumerate(waiting):
                nodes[:] = sorted(filter(may_split, nodes), key=order)
                while nodes and leaves[t] < budget:
                    node = nodes[0]
                    if node not in children:
                        break
                    nodes.pop(0)
                    done.add(node)
                    leaves[t] += 1
                    nodes += filter(may_split, children[node])
                    nodes.sort(key=order)
                if leaves[t] < budget:
                    ahead += [n for n in nodes[: budget - leaves[t]] if n not in children]
            if not ahead:
                break
            for node in ahead:
                children[node] = self.split(node)
            # leaves of the last level need no look
            deep = [n for n in ahead if self.level[n] + 1 < self.settings.depth]
            self.look_at(deep, [children[n] for n in deep])
        undone: list[set[int]] = [set() for _ in self.trees]
        for t, number in children:
            if (t, number) not in done:
                undone[t].add(number)
        return [tree.without(undone[t]) for t, tree in enumerate(self.trees)]


# --- models ------------------------------------------------------------------------------------


@dataclass
class BoostedDetector:
    """Boosted trees with the detectors' interface: ``predict`` adds ``proba`` and ``y_pred``."""

    features: list[str]
    classes: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[Round]
    settings: Boosting
    timing: dict[str, float] = field(default_factory=dict)

    def scores(self, values: np.ndarray) -> np.ndarray:
        codes = codes_of(values, self.edges)
        start = np.tile(self.base, (len(values), 1))
        return add_rounds(start, self.rounds, codes, self.settings.rate)

    def predict(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(replace(self, timing={}))
        schema = StructType([
            *df.schema.fields, StructField("proba", MapType(StringType(), DoubleType())), StructField("y_pred", StringType()),
        ])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            n = len(model.classes)
            names = np.array(model.classes, object)
            for batch in batches:
                values = matrix(batch.column(0), len(model.features))
                share = probabilities(model.scores(values))
                proba = pa.MapArray.from_arrays(
                    pa.array(np.arange(len(share) + 1) * n, pa.int32()),
                    pa.array(model.classes * len(share), pa.string()),
                    pa.array(share.ravel(), pa.float64()),
                )
                predicted = pa.array(names[share.argmax(1)].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], proba, predicted], names=schema.names)

        # names of any kind come back with the schema
        own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
        rows = df.select(feature_array(self.features).alias("x"), *own)
        return rows.mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps(
            {
                "features": self.features, "classes": self.classes, "edges": [e.tolist() for e in self.edges],
                "base": self.base.tolist(), "settings": asdict(self.settings),
                "rounds": [[asdict(t) for t in trees] for trees in self.rounds],
            }
        )
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedDetector:
        held = json.loads(spark.read.text(path).first()[0])
        return BoostedDetector(
            held["features"],
            held["classes"],
            [np.array(e, float) for e in held["edges"]],
            np.array(held["base"], float),
            [[Tree(**t) for t in trees] for trees in held["rounds"]],
            Boosting(**held["settings"]),
        )

    def splits(self, spark: SparkSession) -> DataFrame:
        """(round, class, node, feature, up_to, missing_left, gain, left, right, value) of all nodes."""
        rows = []
        for r, trees in enumerate(self.rounds):
            for t, tree in enumerate(trees):
                name = self.classes[1] if len(trees) == 1 else self.classes[t]
                for i, f in enumerate(tree.feature):
                    own = self.edges[f] if f >= 0 else []
                    up_to = float(own[tree.cut[i]]) if f >= 0 and tree.cut[i] < len(own) else None
                    inner = (self.features[f], up_to, tree.missing_left[i], tree.gain[i], tree.left[i], tree.right[i])
                    rows.append((r, name, i, *(inner if f >= 0 else [None] * 6), tree.value[i] if f < 0 else None))
        return spark.createDataFrame(
            rows,
            "round int, class string, node int, feature string, up_to double, missing_left boolean, gain double, "
            "left int, right int, value double",
        )


def fit(
    df: DataFrame, features: Sequence[str], label: str, settings: Boosting, weight: str | None = None
) -> BoostedDetector:
    """Trees for all classes of ``label`` together; rows without a label teach nothing.

    Missing feature values go to the side that gains more. The first scores are the log shares
    of the classes by weight.
    """
    start = time.perf_counter()
    own_weight = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    shares = (
        df.where(F.col(f"`{label}`").isNotNull())
        .groupBy(F.col(f"`{label}`").cast("string").alias("label"))
        .agg(F.sum(own_weight).alias("w"))
        .limit(CODES * CODES)
        .collect()
    )
    total = {r["label"]: r["w"] for r in shares}
    classes = sorted(total)
    if len(classes) < 2:
        raise ValueError(f"column {label} holds a single class")
    share = np.array([total[c] for c in classes]) / sum(total[c] for c in classes)
    logs = np.log(np.maximum(share, 1e-12))
    base = logs[1:] - logs[:1] if len(classes) == 2 else logs
    edges = bin_edges(df, features, settings.bins)
    parts = kept(make_parts(df, features, label, weight, classes, edges, base))
    rounds: list[Round] = []
    since: list[Round] = []
    for _ in range(settings.rounds):
        growth = Growth(parts, since, n_trees(len(classes)), len(features), settings)
        trees = growth.best_first() if settings.leaves else growth.by_level()
        rounds.append(trees)
        since.append(trees)
        if len(since) == INTERVAL and len(rounds) < settings.rounds:
            parts, since = kept(_rescored(parts.rows, since, len(features), settings.rate)), []
    detector = BoostedDetector(list(features), classes, edges, base, rounds, settings)
    detector.timing["fit_s"] = time.perf_counter() - start
    return detector


def _rescored(parts: DataFrame, since: list[Round], n_features: int, rate: float) -> DataFrame:
    trees = len(since[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                add_rounds(old, since, codes, rate).astype("<f8").tobytes()
                for codes, _, _, old in parts_of(batch, n_features, trees)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.binary())], names=batch.schema.names)

    return parts.mapInArrow(run, PARTS)
