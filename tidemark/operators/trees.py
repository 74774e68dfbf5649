"""Tree ensembles as arrays, and trees with random thresholds, which Spark ML lacks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Forest:
    """A tree ensemble as arrays: of each node its feature (-1: leaf), threshold, children and value; where trees begin, and their weights."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Weighted sums of the leaves that rows reach; all trees go down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        while (self.feature[at] >= 0).any():
            inner = self.feature[at] >= 0
            own = np.take_along_axis(x, np.maximum(self.feature[at], 0), axis=1)
            at = np.where(inner, np.where(own <= self.threshold[at], self.left[at], self.right[at]), at)
        return self.value[at] @ self.weights


def flattened(model) -> Forest:
    """The arrays of a fitted forest or boosted trees; as many nodes pass through the driver as the trees have."""
    rows, roots = [], []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = split.featureIndex(), split.threshold()
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        return at

    for tree in model.trees:
        roots.append(add(tree._java_obj.rootNode()))
    columns = [np.array(c) for c in zip(*rows)]
    weights = np.array(model.treeWeights, dtype=float)
    if isinstance(model, RandomForestRegressionModel):
        weights = weights / weights.sum()
    return Forest(columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4].astype(float), np.array(roots), weights)


def draws(seed: int, tree: int, node: int, features: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The features that a node tries, in order, and for every feature the place of its threshold between the node's least and greatest value."""
    rng = np.random.default_rng([seed, tree, node])
    tried = np.sort(rng.permutation(features)[: max(1, round(share * features))])
    return tried, rng.random(features)


class _Growing:
    """Trees while they grow: nodes are numbered 1 for the root and 2 i, 2 i + 1 for the children of i; of each node its feature (-1: none yet) and threshold."""

    def __init__(self, trees: int, depth: int):
        self.feature = np.full((trees, 2 << depth), -1, dtype=np.int64)
        self.threshold = np.full((trees, 2 << depth), np.inf)
        self.level = 0

    def place(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        flat, first, at = x.ravel(), np.arange(len(x)) * x.shape[1], np.ones(len(x), dtype=np.int64)
        column, threshold = np.maximum(self.feature[tree], 0), self.threshold[tree]
        # nothing is right of the threshold of a node without a feature, and its rows stay
        left = np.where(self.feature[tree] >= 0, 2, 1) * np.arange(len(column))
        for _ in range(self.level):
            at = left.take(at) + (flat.take(first + column.take(at)) > threshold.take(at))
        return at

    def in_codes(self, values: list[np.ndarray]) -> _Growing:
        """The same trees for codes: each threshold becomes the last code, of a feature's values in order, that isn't above it."""
        out = _Growing(0, 0)
        out.feature, out.level, out.threshold = self.feature, self.level, np.full(self.feature.shape, ROWS, dtype=np.int32)
        for f, v in enumerate(values):
            own = self.feature == f
            out.threshold[own] = np.searchsorted(v, self.threshold[own], side="right") - 1
        return out


#: Rows of a block at most, so that a code has 16 bits and is under 65,535.
ROWS = 65_535


def _blocks(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """x and y of the rows of Arrow batches, joined to blocks of at most `most` rows."""
    held, n = [], 0
    for batch in batches:
        for part in (batch.slice(at, most) for at in range(0, batch.num_rows, most)):
            if n + part.num_rows > most:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n = [], 0
            held.append((part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part.column("y").to_numpy(zero_copy_only=False)))
            n += part.num_rows
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def coded(rows: DataFrame) -> DataFrame:
    """(x, y) rows as blocks (codes, sizes, values, y) of at most 65,535 rows: of each feature the block's different values in order, and of each row their numbers.

    A code keeps the order of what it stands for, so cuts and ranges are exact, and a row takes
    two bytes a feature however often it is read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _blocks(batches):
            codes, values = np.empty(x.shape, dtype=np.uint16), []
            for f in range(x.shape[1]):
                different, codes[:, f] = np.unique(x[:, f], return_inverse=True)
                values.append(different)
            block = {"codes": codes.tobytes(), "sizes": [len(v) for v in values], "values": np.concatenate(values).astype(float).tobytes(), "y": y.astype(float).tobytes()}
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.list_(pa.int32()) if k == "sizes" else pa.binary()) for k, v in block.items()})

    return rows.mapInArrow(run, "codes binary, sizes array<int>, values binary, y binary")


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """codes, values and y of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            codes, values, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind) for c, kind in (("codes", np.uint16), ("values", float), ("y", float)))
            sizes = batch.column("sizes")[i].as_py()
            yield codes.reshape(len(y), len(sizes)), np.split(values, np.cumsum(sizes)[:-1]), y


#: Lines that are taken together where there are many, as numpy's cost of short ones is by the line.
FOLD = 16

#: Rows that are compared at once, so that what they become stays in a core's cache.
STEP = 2_048


def _ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of each column."""
    whole, width = len(codes) // FOLD * FOLD if len(codes) >= STEP else 0, codes.shape[1]
    folded = codes[:whole].reshape(-1, FOLD * width)
    return tuple(f(np.concatenate([codes[whole:], *([f(folded, axis=0).reshape(FOLD, width)] if whole else [])]), axis=0) for f in (np.min, np.max))


def _under(codes: np.ndarray, cut: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows where each column is under its cut their number and the sum of y, in two lines."""
    both = np.stack([np.ones(len(y)), y])
    return sum(both[:, at:at + STEP] @ (codes[at:at + STEP] < cut).astype(float) for at in range(0, len(y), STEP))


def _sums(rows: DataFrame, growing: _Growing, open_: list[np.ndarray], cuts: list[np.ndarray] | None) -> pd.DataFrame:
    """(tree, node, feature) with n, s, lo and hi of all rows of the open nodes, or with those left of each feature's cut.

    rows: (x, y) rows or their blocks. Each task adds up its rows before anything moves, so four
    numbers for each open node and feature leave it, in a row a tree: as many as the trees have,
    not as the table has.
    """
    kinds = "tree int, n binary, s binary, lo binary, hi binary"
    names, neutral, joined = ("n", "s", "lo", "hi"), (0.0, 0.0, np.inf, -np.inf), (np.add, np.add, np.minimum, np.maximum)

    def batch(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"tree": pa.array(list(held), pa.int32()), **{c: pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i, c in enumerate(names)}})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for x, values, y in _read_blocks(batches):
            if not held:
                held = {t: [np.full((len(o), x.shape[1]), v) for v in neutral] for t, o in enumerate(open_) if len(o)}
            offsets, every, own = np.cumsum([0, *map(len, values)])[:-1], np.concatenate(values), growing.in_codes(values)
            for tree, (n, s, lo, hi) in held.items():
                at = own.place(tree, x).astype(np.min_scalar_type(growing.feature.shape[1]))
                order = np.argsort(at, kind="stable")
                at, xs, ys = at.take(order), x.take(order, axis=0), y.take(order)
                # rows of a node lie side by side: each node's are added up in one go
                first, last = np.searchsorted(at, open_[tree]), np.searchsorted(at, open_[tree], side="right")
                if cuts is not None:
                    above = np.stack([np.searchsorted(v, cuts[tree][:, f], side="right") for f, v in enumerate(values)], axis=1).astype(np.uint16)
                for i in np.flatnonzero(last > first):
                    codes, target = xs[first[i]:last[i]], ys[first[i]:last[i]]
                    if cuts is None:
                        least, greatest = _ends(codes)
                        n[i] += len(target)
                        s[i] += target.sum()
                        lo[i] = np.minimum(lo[i], every.take(offsets + least))
                        hi[i] = np.maximum(hi[i], every.take(offsets + greatest))
                    else:
                        count, total = _under(codes, above[i], target)
                        n[i] += count
                        s[i] += total
        if held:
            yield batch(held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for i, tree in enumerate(b.column("tree").to_pylist()):
                own = [np.frombuffer(b.column(c)[i].as_buffer()) for c in names]
                held[tree] = [f(x, y) for f, x, y in zip(joined, held[tree], own)] if tree in held else [v.copy() for v in own]
        if held:
            yield batch(held)

    blocks = rows if "codes" in rows.columns else coded(rows)
    found, out = blocks.mapInArrow(measured, kinds).repartition(min(4, len(open_)), "tree").mapInArrow(added, kinds).toArrow().to_pylist(), []
    for r in sorted(found, key=lambda r: r["tree"]):
        own, nodes = {c: np.frombuffer(r[c]) for c in names}, open_[r["tree"]]
        width = len(own["n"]) // len(nodes)
        out.append(pd.DataFrame({"tree": r["tree"], "node": np.repeat(nodes, width), "feature": np.tile(np.arange(width), len(nodes)), **own}))
    return pd.concat(out) if out else pd.DataFrame(columns=["tree", "node", "feature", *names])


def _by_tree(found: pd.DataFrame, open_: list[np.ndarray], column: str, features: int) -> list[np.ndarray]:
    return [found.loc[found["tree"] == t, column].to_numpy().reshape(len(o), features) for t, o in enumerate(open_)]


def grow(rows: DataFrame, features: int, trees: int, depth: int, least: int, share: float, seed: int) -> tuple[Forest, np.ndarray]:
    """Extremely randomised trees on (x, y) rows or their blocks, and the importance of each feature.

    A node tries a share of the features, each at one threshold drawn between the least and
    greatest value of its own rows, and takes the cut that lowers the squared error most, the
    first of equals; both sides keep `least` rows at least. All nodes of a level, of all trees,
    are measured together: one aggregate for ranges and one for cuts. What goes through the
    driver is a number for each open node and feature, bounded by trees * 2 ** depth * features.
    """
    growing, value, gain = _Growing(trees, depth), [{} for _ in range(trees)], np.zeros((trees, features))
    open_ = [np.array([1]) for _ in range(trees)]
    for level in range(max(1, depth)):
        if not any(len(o) for o in open_):
            break
        ranges = _sums(rows, growing, open_, None)
        if ranges.empty:
            raise ValueError("no rows to grow trees on")
        n, s, lo, hi = (_by_tree(ranges, open_, c, features) for c in ("n", "s", "lo", "hi"))
        places = [[draws(seed, t, int(node), features, share) for node in o] for t, o in enumerate(open_)]
        cuts = [np.array([lo[t][i] + u * (hi[t][i] - lo[t][i]) for i, (_, u) in enumerate(p)]).reshape(len(p), features) for t, p in enumerate(places)]
        for t, o in enumerate(open_):
            value[t].update({int(node): s[t][i, 0] / n[t][i, 0] for i, node in enumerate(o)})
        if level == depth:
            break
        left = _sums(rows, growing, open_, cuts)
        ln, ls = (_by_tree(left, open_, c, features) for c in ("n", "s"))
        following = []
        for t, o in enumerate(open_):
            new: list[int] = []
            for i, node in enumerate(o):
                total, rn, rs = n[t][i, 0], n[t][i] - ln[t][i], s[t][i] - ls[t][i]
                able = np.zeros(features, dtype=bool)
                able[places[t][i][0]] = True
                able &= (ln[t][i] >= least) & (rn >= least)
                better = np.where(able, ls[t][i] ** 2 / np.maximum(ln[t][i], 1) + rs**2 / np.maximum(rn, 1) - s[t][i, 0] ** 2 / total, -np.inf)
                # what differs by rounding alone is equal, in whatever order tasks were added up
                best = int((better >= better.max() - 1e-12 * max(1.0, s[t][i, 0] ** 2 / total)).argmax())
                if better[best] > 1e-12 * max(1.0, abs(s[t][i, 0])):
                    growing.feature[t, node], growing.threshold[t, node] = best, cuts[t][i, best]
                    gain[t, best] += better[best]
                    new += [2 * int(node), 2 * int(node) + 1]
                    # leaves of the last level need no further pass: both sides have been added up
                    value[t].update({new[-2]: ls[t][i, best] / ln[t][i, best], new[-1]: rs[best] / rn[best]})
            following.append(np.array(new, dtype=np.int64))
        open_, growing.level = following, level + 1
    nodes, roots = [], []
    for t in range(trees):
        number = {node: len(nodes) + i for i, node in enumerate(sorted(value[t]))}
        roots.append(number[1])
        for node in sorted(value[t]):
            feature = int(growing.feature[t, node])
            nodes.append((feature, float(growing.threshold[t, node]) if feature >= 0 else 0.0, number.get(2 * node, 0), number.get(2 * node + 1, 0), value[t][node]))
    columns = [np.array(c) for c in zip(*nodes)]
    forest = Forest(columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4].astype(float), np.array(roots), np.full(trees, 1 / trees))
    each = gain / np.where(gain.sum(axis=1, keepdims=True) > 0, gain.sum(axis=1, keepdims=True), 1)
    return forest, each.mean(axis=0) / max(1e-300, each.mean(axis=0).sum())


class ExtraTrees(Estimator):
    """M1: extremely randomised trees as an estimator on `features` and `target`, to stand beside Spark ML's."""

    def __init__(self, trees: int = 20, depth: int = 8, least: int = 1, share: float = 0.85, seed: int = 42):
        super().__init__()
        self.options = {"trees": trees, "depth": depth, "least": least, "share": share, "seed": seed}

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("target").cast("double").alias("y")).filter("y is not null")
        blocks = coded(rows).cache()
        try:
            width = blocks.select(F.size("sizes").alias("n")).first()
            if width is None:
                raise ValueError("no rows to grow trees on")
            forest, gain = grow(blocks, width["n"], **self.options)
        finally:
            blocks.unpersist()
        return ExtraTreesModel(forest, gain)


class ExtraTreesModel(Model):
    """The fitted trees; predictions by arrays, a batch at a time."""

    def __init__(self, forest: Forest, gain: np.ndarray):
        super().__init__()
        self.forest, self.featureImportances = forest, DenseVector(gain)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest = self.forest

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(forest.predict(np.array(x.tolist(), dtype=float)) if len(x) else [])

        return dataset.withColumn("prediction", predict(vector_to_array("features")))
