"""Gradient-boosted trees over all rows of a table, and their calibration. Fitted from sums that tasks make, applied in tasks.

Equal rows are one row with a count, features are the numbers of their bins, a byte each. For each level of a tree the tasks apply the trees so
far and add up rows, gradients and their slopes per node, feature and bin; only these sums reach the driver, however many rows there are. Gradients
are summed as whole numbers, so the trees do not depend on the order or the place of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from roadlog.llm.common import cut, pieces

FINE = 2.0 ** 32            # gradients are summed in whole numbers of this share
STEP = 4096                 # margins are whole numbers of this share
PART = 20_000               # different rows that one task takes of a pass

Node = tuple[int, float, float, float]          # feature, bound, value, gain


class Trees:
    """Depth-limited regression trees on binned features, fitted to the log loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base = 0.0
        self.trees: list[list[Node]] = []
        self.slope, self.shift = 1.0, 0.0

    def fit(self, share: float, sums: Callable[[Trees, list[Node], int], np.ndarray]) -> Trees:
        """`share` of the rows are positive; sums(trees, tree, level) are those of `added` over all rows. The bounds are numbers of bins."""
        rate = np.clip(share, 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        for _ in range(self.rounds):
            self.trees.append(self._tree(sums))
        return self

    def _value(self, g: float, h: float) -> float:
        return float(-self.rate * g / (h + 1.0))

    def _tree(self, sums: Callable[[Trees, list[Node], int], np.ndarray]) -> list[Node]:
        nodes: list[Node] = [(-1, 0.0, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        there = {0}
        for level in range(self.depth):
            found, first = sums(self, nodes, level), 2 ** level - 1
            for node in sorted(n for n in there if n >= first):
                n, g, h = (np.cumsum(found[node - first, :, :, k], axis=1) for k in range(3))
                rows, g, h = n[0, -1], g / FINE, h / FINE
                all_g, all_h = g[0, -1], h[0, -1]
                if level == 0:
                    nodes[0] = (-1, 0.0, self._value(all_g, all_h), 0.0)
                n, g, h = n[:, :-1], g[:, :-1], h[:, :-1]
                gain = g ** 2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g ** 2 / (all_h + 1)
                gain[(n < self.least) | (rows - n < self.least)] = 0
                f, at = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, at] <= 1e-6:
                    continue
                nodes[node] = (int(f), float(at), nodes[node][2], float(gain[f, at]))
                nodes[2 * node + 1] = (-1, 0.0, self._value(g[f, at], h[f, at]), 0.0)
                nodes[2 * node + 2] = (-1, 0.0, self._value(all_g - g[f, at], all_h - h[f, at]), 0.0)
                there |= {2 * node + 1, 2 * node + 2}
            if not any(n > 2 * first for n in there):
                break
        return nodes

    def added(self, tree: list[Node], level: int, codes: np.ndarray, hit: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows, gradients and their slopes by node of a level, feature and bin; `tree` is the one that is being made."""
        place = self._place(tree, codes) - (2 ** level - 1)
        codes, hit, n, place = codes[place >= 0], hit[place >= 0], n[place >= 0], place[place >= 0]
        p = 1 / (1 + np.exp(-self._sum(codes)))
        features = codes.shape[1]
        key = ((place[:, None] * features + np.arange(features)) * self.bins + codes).ravel()
        out = np.zeros((2 ** level * features * self.bins, 3), np.int64)
        for k, each in enumerate((n, np.rint((p - hit) * FINE).astype(np.int64) * n, np.rint(p * (1 - p) * FINE).astype(np.int64) * n)):
            np.add.at(out[:, k], key, np.repeat(each, features))
        return out.reshape(2 ** level, features, self.bins, 3)

    @staticmethod
    def _place(tree: list[Node], x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, bound = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        at = np.zeros(len(x), np.int64)
        while (feature[at] >= 0).any():
            inner = feature[at] >= 0
            right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > bound[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def _sum(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((np.array([n[2] for n in t])[self._place(t, x)] for t in self.trees), np.zeros(len(x)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.rint(self._sum(x) * STEP) / STEP

    def on_values(self, bounds: list[np.ndarray]) -> Trees:
        """These trees for values in place of the numbers of their bins."""
        self.trees = [[(f, float(bounds[f][int(at)]) if f >= 0 else 0.0, value, gain) for f, at, value, gain in tree] for tree in self.trees]
        return self

    def calibrate(self, margin: np.ndarray, y: np.ndarray, n: np.ndarray) -> Trees:
        """Fit a sigmoid of the margin on rows the trees have not seen, each there n times."""
        self.slope, self.shift = logistic(margin[:, None], y, n=n)[:2]
        return self

    def likely(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.likely(self.margin(x))


def bin_bounds(values: np.ndarray, times: np.ndarray, bins: int) -> np.ndarray:
    """The different inner quantiles of values, sorted, of which each is there so many times."""
    last = np.cumsum(times)
    at = np.linspace(0, 1, bins + 1)[1:-1] * (last[-1] - 1)
    low = np.floor(at)
    a, b = (values[np.searchsorted(last, np.minimum(x, last[-1] - 1), side="right")] for x in (low, low + 1))
    t = at - low
    return np.unique(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))


def _measured(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """The bounds of the bins of each feature."""
    each = rows.select("n", F.posexplode(F.split("features", " ")).alias("feature", "text")).withColumn("value", F.col("text").cast("double"))
    counted = each.groupBy("feature", "value").agg(F.sum("n").alias("n")).orderBy("feature", "value").toArrow()
    feature, value, n = (counted.column(c).to_numpy() for c in ("feature", "value", "n"))
    return [bin_bounds(value[feature == f], n[feature == f], bins) for f in range(feature.max() + 1)]


def _coded(rows: DataFrame, bounds: list[np.ndarray]) -> DataFrame:
    """kind (the first feature), codes, hit, held and how many rows there are of each, a written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([t.split() for t in batch.column(0).to_pylist()], float).reshape(-1, len(bounds))
            codes = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary()), *batch.columns[1:]],
                                             ["kind", "codes", "hit", "held", "n"])

    made = rows.select("features", "hit", "held", "n").mapInArrow(run, "kind long, codes binary, hit boolean, held boolean, n long")
    same = cut(made.groupBy("kind", "codes", "hit", "held").agg(F.sum("n").alias("n")))
    return cut(same.repartition(pieces(same.count(), PART)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch of (codes, hit, n): their bytes one after another."""
    for batch in batches:
        columns = [b"".join(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False).tobytes(), batch.column(2).to_numpy().tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["codes", "hit", "n"])


def _unpacked(row: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hit, n = np.frombuffer(row["hit"], bool).astype(float), np.frombuffer(row["n"], np.int64)
    return np.frombuffer(row["codes"], np.uint8).reshape(len(n), -1), hit, n


def learned(rows: DataFrame) -> tuple[Trees, DataFrame]:
    """Trees fitted to the rows that are not held, and of those held how many (n) there are of each kind, margin and hit.

    `rows` (features, hit, held, n) are read twice; features are numbers with a space between, the first is a whole number, the kind.
    A pass adds up in a tree of tasks, so the driver gets a few sums of some hundred kilobytes.
    """
    trees = Trees()
    bounds = _measured(rows.filter("not held"), trees.bins)
    coded = _coded(rows, bounds)
    seen = coded.filter("not held").select("codes", "hit", "n")
    n, hits = seen.agg(F.sum("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))).first()
    kept = seen.mapInArrow(_packed, "codes binary, hit binary, n binary").rdd.map(_unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    trees.fit(hits / n, lambda trees, tree, level: kept.map(lambda part: trees.added(tree, level, *part)).treeReduce(np.add))
    kept.unpersist()

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(trees.margin(codes)), *batch.columns[1:]], ["margin", "hit", "n", "kind"])

    held = coded.filter("held").select("codes", "hit", "n", "kind").mapInArrow(margins, "margin double, hit boolean, n long, kind long")
    found = cut(held.groupBy("kind", "margin", "hit").agg(F.sum("n").alias("n")))
    return trees.on_values(bounds), found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, n: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression, the constant last. Each row is there n times, or once."""
    full = np.column_stack([x, np.ones(len(x))])
    n = np.ones(len(x)) if n is None else n
    w = np.zeros(full.shape[1])

    def loss(v: np.ndarray) -> float:
        z = full @ v
        return float((n * np.logaddexp(0, np.where(y > 0.5, -z, z))).sum() + ridge / 2 * (v @ v))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        hess = (full * (n * p * (1 - p))[:, None]).T @ full + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, full.T @ (n * (y - p)) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float, otherwise: float = 0.99) -> float:
    """The least probability from which on held-out rows, each there n times, are right often enough; of equal ones those that are right come first."""
    order = np.lexsort((-y, -p))
    p, y, n = p[order], y[order], n[order]
    hits, rows = np.cumsum(n * y), np.cumsum(n)
    right = np.where(y > 0, hits / rows, hits / (rows - n + 1))         # of equal rows the best place: the last that is right, the first that is not
    good = np.flatnonzero(right >= precision)
    return max(0.5, float(p[good[-1]])) if len(good) else otherwise
