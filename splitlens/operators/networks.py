"""A multi-layer perceptron for regression and any number of classes, trained on a table where its rows lie.

Each iteration is one job: tasks sum the gradients of their rows, sums of many partitions are added in tasks again, and the
driver, which holds the parameters, gets a few sums and takes a step (Adam). Whole-table gradients make the result
independent of how rows are dealt, but for rounding. Features are scaled to unit deviation without centering; numeric
targets are standardized within.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlens.session import written

HIDDEN, ITERATIONS, RATE, PENALTY = (256, 128), 300, 1e-2, 1e-4
FAN = 64  # sums that one task, or the driver, adds


@dataclass(frozen=True)
class Shape:
    """Sizes of layers, and where each one's weights lie in the vector of all parameters."""

    sizes: tuple[int, ...]
    classes: bool

    def parts(self, theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def start(self, seed: int) -> np.ndarray:
        r = np.random.Generator(np.random.PCG64(seed))
        return np.concatenate([np.concatenate([r.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(self.sizes, self.sizes[1:], strict=False)])

    def outputs(self, theta: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """The activations of all layers; the last are numbers, or probabilities of classes."""
        layers, out = self.parts(theta), [x]
        for k, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(z if k == len(layers) - 1 else np.maximum(z, 0))
        if self.classes:
            z = np.exp(out[-1] - out[-1].max(1, keepdims=True))
            out[-1] = z / z.sum(1, keepdims=True)
        return out

    def slope(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sum of the rows' losses, and behind it that of its gradients. ``y`` has a column for each output."""
        out, layers, grads = self.outputs(theta, x), self.parts(theta), []
        loss = -(y * np.log(np.maximum(out[-1], 1e-300))).sum() if self.classes else ((out[-1] - y) ** 2).sum() / 2
        error = out[-1] - y
        for k in range(len(layers) - 1, -1, -1):
            grads.append(np.concatenate([(out[k].T @ error).ravel(), error.sum(0)]))
            error = (error @ layers[k][0].T) * (out[k] > 0) if k else error
        return np.concatenate([[loss], *reversed(grads)])


def _summed(data: DataFrame, parts: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a vector of each batch (features, targets) over the table, which has ``parts`` partitions."""

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        return of(x, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))

    return sums(data, parts, numbers)


def sums(data: DataFrame, parts: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of a vector of each batch over the table, which has ``parts`` partitions."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = of(batch)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                one = np.frombuffer(v.as_buffer(), np.float64)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    sums = data.mapInArrow(each, "v binary")
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.coalesce(parts).mapInArrow(again, "v binary")
    found = [np.frombuffer(bytes(r.v), np.float64) for r in sums.collect()]
    return np.sum(found, axis=0) if found else np.zeros(0)


@dataclass
class Network:
    shape: Shape
    theta: np.ndarray
    scale: np.ndarray
    labels: list[float] = field(default_factory=list)  # of classes, by output
    centre: float = 0.0
    spread: float = 1.0

    def predicted(self, table: DataFrame, column: str = "features") -> DataFrame:
        """``table`` with ``prediction`` (a number, or the likeliest label) and ``probabilities`` (of labels; null for numbers)."""
        kind, where = table.schema, table.columns.index(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(where).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                out = self.shape.outputs(self.theta, x / self.scale)[-1]
                if self.labels:
                    number, shares = np.array(self.labels)[out.argmax(1)], pa.array(list(out), pa.list_(pa.float64()))
                else:
                    number, shares = out[:, 0] * self.spread + self.centre, pa.nulls(batch.num_rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.float64()), shares], names=[*batch.schema.names, "prediction", "probabilities"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
        return table.mapInArrow(run, f"{fields}, prediction double, probabilities array<double>")


def fit(table: DataFrame, task: str, hidden: tuple[int, ...] = HIDDEN, iterations: int = ITERATIONS, seed: int = 0, rate: float = RATE) -> Network:
    """A network from ``features`` (an array of numbers, of one length) and ``y``. For classification the labels are the different
    values of ``y``; rows without ``y`` don't count."""
    data = written(table.where("y is not null").select(F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y")), "network-rows")
    parts = data.select(F.spark_partition_id().alias("part")).distinct().count()
    moments = _summed(data, parts, lambda x, y: np.concatenate([[len(y), y.sum(), (y * y).sum()], x.sum(0), (x * x).sum(0)]))
    if not len(moments):
        raise ValueError("a network needs rows")
    n, width = moments[0], (len(moments) - 3) // 2
    mean, square = moments[3 : 3 + width] / n, moments[3 + width :] / n
    scale = np.sqrt(np.maximum(square - mean * mean, 0))
    scale[scale == 0] = 1.0
    labels = [r.y for r in data.select("y").distinct().orderBy("y").collect()] if task == "classification" else []
    centre = 0.0 if labels else moments[1] / n
    spread = 1.0 if labels else float(np.sqrt(max(moments[2] / n - centre**2, 0)) or 1.0)
    shape = Shape((width, *hidden, len(labels) or 1), bool(labels))
    known = np.array(labels)
    theta = shape.start(seed)
    m = v = np.zeros_like(theta)
    for t in range(1, iterations + 1):

        def slope(x: np.ndarray, y: np.ndarray, theta: np.ndarray = theta) -> np.ndarray:
            target = (y[:, None] == known[None]).astype(np.float64) if labels else (y[:, None] - centre) / spread
            return shape.slope(theta, x / scale, target)

        g = _summed(data, parts, slope)[1:] / n + PENALTY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Network(shape, theta, scale, labels, centre, spread)
