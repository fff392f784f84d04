"""Boosted trees grown leaf by leaf on histograms, from a table whose rows stay where they lie.

Features become bins once, at quantiles of some ``EDGE_ROWS`` rows, by hash (all rows, if there are fewer). A pass over the table is one job: tasks send their rows down the tree grown so far and
sum gradients, curvatures and counts by leaf, feature and bin; the driver gets a few sums, whose size is leaves x features x
bins whatever the rows, and splits the leaf that gains most, then the next, while it knows the gains. Leaves that this makes are
measured together in the next pass, so the tree is the one that a pass for each leaf would give. Margins of rows are written every
``KEPT`` rounds, which also ends the lineage; trees since then are applied on the way.

Rows are not sampled; a share of the features is drawn for each tree. A round that finds no split is the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.operators.networks import sums
from splitlens.session import written

ROUNDS, RATE, LEAVES, SHARE = 800, 0.05, 31, 0.8
BINS, LEAST_ROWS, LEAST_CURVE = 64, 20, 1e-3
KEPT, ACCURACY, EDGE_ROWS = 25, 10_000, 200_000


@dataclass
class Tree:
    """Nodes by number, the root first: ``feature`` (-1: a leaf), the last bin that goes ``left``, and values of leaves."""

    feature: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            node = at[rows]
            at[rows] = np.where(bins[rows, self.feature[node]] <= self.last[node], self.left[node], self.right[node])
        return at


@dataclass
class Found:
    """What is known of a node: sums of gradients and curvatures, and its best split."""

    slope: float
    curve: float
    gain: float
    feature: int
    last: int


def best_split(cells: np.ndarray, features: np.ndarray, least_rows: int = LEAST_ROWS) -> Found:
    """From sums by feature and bin of (gradient, curvature, rows); equal gains go to the first feature, then the lowest bin."""
    left = np.cumsum(cells, axis=1)
    all_of = left[0, -1]
    left, right = left[:, :-1], all_of - left[:, :-1]
    fits = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= LEAST_CURVE) & (right[..., 1] >= LEAST_CURVE)
    gain = np.full(fits.shape, -np.inf)
    gain[fits] = left[fits][:, 0] ** 2 / left[fits][:, 1] + right[fits][:, 0] ** 2 / right[fits][:, 1] - all_of[0] ** 2 / max(all_of[1], LEAST_CURVE)
    gain = np.where(gain > 1e-9, np.round(gain, 9), -np.inf)  # sums differ in their last digits by the order of partitions
    k = int(gain.argmax()) if gain.size else 0
    f, b = divmod(k, max(1, gain.shape[1]))
    return Found(float(all_of[0]), float(all_of[1]), float(gain.flat[k]) if gain.size else -np.inf, int(features[f]), b)


class Grower:
    """A tree while it grows; children get their numbers when their parent is first split."""

    def __init__(self, leaves: int):
        self.leaves, self.known, self.children = leaves, {}, {}

    def chosen(self) -> tuple[set[int], set[int]]:
        """Nodes that are split, best first, and the leaves that this leaves."""
        split, ends = set(), {0}
        while len(ends) < self.leaves:
            open_ = [(-self.known[i].gain, i) for i in ends if i in self.known and np.isfinite(self.known[i].gain)]
            if not open_:
                break
            i = min(open_)[1]
            if i not in self.children:
                n = 1 + 2 * len(self.children)
                self.children[i] = (n, n + 1)
            split.add(i)
            ends = ends - {i} | set(self.children[i])
        return split, ends

    def tree(self, split: set[int], rate: float = 0.0) -> Tree:
        n = 1 + 2 * len(self.children)
        t = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
        for i in range(n):
            if i in split:
                t.feature[i], t.last[i], (t.left[i], t.right[i]) = self.known[i].feature, self.known[i].last, self.children[i]
            elif i in self.known:
                t.value[i] = -rate * self.known[i].slope / max(self.known[i].curve, LEAST_CURVE)
        return t


def _bins(batch: pa.RecordBatch) -> np.ndarray:
    raw = batch.column(batch.schema.get_field_index("bins"))
    return np.array([np.frombuffer(v.as_buffer(), np.uint8) for v in raw])


def slopes(margin: np.ndarray, y: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the loss: logistic, or half the squared error."""
    if not classes:
        return margin - y, np.ones_like(y)
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def histogram(bins: np.ndarray, node: np.ndarray, wanted: list[int], features: np.ndarray, width: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums by wanted node, feature and bin of (gradient, curvature, rows)."""
    place = np.full(max(int(node.max(initial=0)), *wanted) + 1, -1)
    place[wanted] = np.arange(len(wanted))
    own = place[node]
    rows = np.flatnonzero(own >= 0)
    cells = ((own[rows, None] * len(features) + np.arange(len(features))) * width + bins[rows][:, features]).ravel()
    size = len(wanted) * len(features) * width
    parts = [np.bincount(cells, np.repeat(w[rows], len(features)), size) for w in (g, h, np.ones(len(g)))]
    return np.stack(parts, -1)


@dataclass
class Boosted:
    edges: list[list[float]]
    start: float
    trees: list[Tree]
    classes: bool

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.start + sum((t.value[t.leaves(bins)] for t in self.trees), np.zeros(len(bins)))

    def predicted(self, table: DataFrame, column: str = "features") -> DataFrame:
        """``table`` with ``prediction``: a number, or the probability of label 1."""
        where = table.columns.index(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = self.margins(binned(batch.column(where), self.edges)) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-m)) if self.classes else m, pa.float64())], names=[*batch.schema.names, "prediction"])

        return table.mapInArrow(run, table.withColumn("prediction", F.lit(None).cast("double")).schema)


def binned(features: pa.Array, edges: list[list[float]]) -> np.ndarray:
    x = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(features), -1)
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8) if edges else np.zeros((len(x), 0), np.uint8)


def quantile_edges(data: DataFrame, n: int, bins: int = BINS, most_rows: int = EDGE_ROWS) -> list[list[float]]:
    """Upper ends of all bins but the last, by feature, at (approximate) quantiles of its values; missing ones lie behind the last."""
    if n > most_rows:
        data = data.where(F.pmod(F.xxhash64("features", "y"), F.lit(1 << 30)) < int((1 << 30) * most_rows / n))
    shares = [k / bins for k in range(1, bins)]
    x, there = F.col("x"), ~F.isnan("x")
    found = data.select(F.posexplode("features").alias("at", "x")).groupBy("at")
    rows = found.agg(F.percentile_approx(F.when(there, x), shares, ACCURACY).alias("ends"), F.max(F.when(there, x)).alias("most"), F.bool_or(~there).alias("gaps")).collect()
    return [sorted(e for e in set(r.ends or ()) if r.gaps or e < r.most) for r in sorted(rows, key=lambda r: r["at"])]


def fit(table: DataFrame, task: str, rounds: int = ROUNDS, *, seed: int = 0, rate: float = RATE, leaves: int = LEAVES, share: float = SHARE, bins: int = BINS, least_rows: int = LEAST_ROWS) -> Boosted:
    """Trees from ``features`` (an array of numbers, of one length) and ``y``: a number, or for classification 0 or 1. Rows without
    ``y`` don't count; a missing number goes to the last bin."""
    classes = task == "classification"
    data = written(table.where("y is not null").select(F.transform(F.col("features").cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan")))).alias("features"), F.col("y").cast("double").alias("y")), "boosting-rows")
    seen = data.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.bool_and(F.col("y").isin(0.0, 1.0)).alias("binary")).first()
    if not seen.n:
        raise ValueError("boosting needs rows")
    if classes and not seen.binary:
        raise ValueError("boosted classes are 0 and 1")
    edges = quantile_edges(data, seen.n, bins)
    mean = min(max(seen["mean"], 1e-6), 1 - 1e-6) if classes else seen["mean"]
    model = Boosted(edges, float(np.log(mean / (1 - mean))) if classes else mean, [], classes)
    width, start = max([len(e) + 1 for e in edges], default=1), model.start

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([row.tobytes() for row in binned(batch.column(0), edges)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column(1), pa.array(np.full(batch.num_rows, start))], names=["bins", "y", "margin"])

    data, draw, since = written(data.mapInArrow(cut, "bins binary, y double, margin double"), "boosting-bins"), np.random.Generator(np.random.PCG64(seed)), 0
    parts = data.select(F.spark_partition_id().alias("part")).distinct().count()
    for _ in range(rounds if edges else 0):
        features = np.sort(draw.choice(len(edges), max(1, int(share * len(edges))), replace=False))
        grower, wanted, recent = Grower(leaves), [0], model.trees[since:]
        while wanted:
            tree = grower.tree(set(grower.children))  # all that was ever split, so that every leaf is reached

            def measured(batch: pa.RecordBatch, tree: Tree = tree, wanted: list[int] = wanted, features: np.ndarray = features, recent: list[Tree] = recent) -> np.ndarray:
                b, y, margin = _bins(batch), *(batch.column(k).to_numpy() for k in (1, 2))
                g, h = slopes(margin + sum((t.value[t.leaves(b)] for t in recent), np.zeros(len(b))), y, classes)
                return histogram(b, tree.leaves(b), wanted, features, width, g, h).ravel()

            cells = sums(data, parts, measured).reshape(len(wanted), len(features), width, 3)
            grower.known |= {i: best_split(c, features, least_rows) for i, c in zip(wanted, cells, strict=True)}
            split, ends = grower.chosen()
            wanted = sorted(i for i in ends if i not in grower.known)
        if not split:
            break
        model.trees.append(grower.tree(split, rate))
        if len(model.trees) - since == KEPT:

            def moved(batches: Iterator[pa.RecordBatch], recent: list[Tree] = model.trees[since:]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        b = _bins(batch)
                        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(batch.column(2).to_numpy() + sum(t.value[t.leaves(b)] for t in recent))], names=batch.schema.names)

            data, since = written(data.mapInArrow(moved, data.schema), "boosting-margins"), len(model.trees)
            parts = data.select(F.spark_partition_id().alias("part")).distinct().count()
    return model
