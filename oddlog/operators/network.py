"""Small dense networks, trained on all rows by full-batch steps whose sums do not depend on order.

Parameters stay on the driver; each step is one pass in which tasks add up the gradients of their rows. Activations,
weights and errors are put on binary grids, so that every product sum is a whole number below 2**53 and exact in doubles,
whatever the batch sizes and partitions. What a task sends is as large as the parameters, and several tasks' sums are
added before the driver sees them. Several starts are trained in the same passes; the one of least loss is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Bits behind the point and largest value of activations, weights and errors.
ACTIVE, WEIGHT, ERROR = (12, 1 << 9), (14, 1 << 6), (14, 1 << 5)
ROWS = 1024  # rows of one exact product
ADDERS = 32  # sums of tasks are added by as many tasks
LOSS_BITS = 20

Layers = list[tuple[np.ndarray, np.ndarray]]


def _grid(x: np.ndarray, kind: tuple[int, int]) -> np.ndarray:
    bits, most = kind
    return np.rint(np.clip(np.nan_to_num(x), -most, most) * (1 << bits))


def _product(a: np.ndarray, w: np.ndarray, left: tuple[int, int] = ACTIVE) -> np.ndarray:
    return _grid(a, left) @ _grid(w, WEIGHT) / (1 << (left[0] + WEIGHT[0]))


ACTIVATIONS = {
    "tanh": (np.tanh, lambda z: 1 - np.tanh(z) ** 2),
    "leaky": (lambda z: np.where(z > 0, z, 0.1 * z), lambda z: np.where(z > 0, 1.0, 0.1)),
}


class Network:
    """Layers of (weights, bias); `kind` is the hidden activation, the last layer is linear."""

    def __init__(self, layers: Layers, kind: str):
        self.layers, self.kind = layers, kind

    def steps(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Inputs of each layer and sums before each activation."""
        act = ACTIVATIONS[self.kind][0]
        inputs, sums = [x], []
        for k, (w, b) in enumerate(self.layers):
            sums.append(_product(inputs[-1], w) + b)
            if k < len(self.layers) - 1:
                inputs.append(act(sums[-1]))
        return inputs, sums

    def output(self, x: np.ndarray, until: int | None = None) -> np.ndarray:
        """Last sums, or the activations of hidden layer `until`."""
        inputs, sums = self.steps(x)
        return sums[-1] if until is None else inputs[until]

    def gradient(self, x: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
        """Whole-number sums over the rows: loss, then weights and bias of each layer."""
        slope = ACTIVATIONS[self.kind][1]
        inputs, sums = self.steps(x)
        z = sums[-1]
        if loss == "logistic":
            error = 1 / (1 + np.exp(-z)) - y
            cost = np.logaddexp(0.0, np.where(y > 0.5, -z, z)).sum(1)
        else:
            error = z - y
            cost = (error * error).sum(1) / 2
        parts = []
        for k in range(len(self.layers) - 1, -1, -1):
            grid = _grid(error, ERROR)
            parts[:0] = [(_grid(inputs[k], ACTIVE).T @ grid).reshape(-1), grid.sum(0) * (1 << ACTIVE[0])]
            if k:
                error = _product(error, self.layers[k][0].T, ERROR) * slope(sums[k - 1])
        total = np.rint(np.clip(np.nan_to_num(cost), 0, 1 << 20) * (1 << LOSS_BITS)).sum()
        return np.concatenate([[total], *parts]).astype(np.int64)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for layer in self.layers for p in layer])

    def moved(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for w, b in self.layers:
            out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(out, self.kind)


def drawn(sizes: list[int], seed: int, kind: str) -> Network:
    rng = np.random.default_rng(seed)
    return Network([(rng.normal(size=(a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:])], kind)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sums(rows: DataFrame, networks: list[Network], loss: str) -> np.ndarray:
    """Row count and gradient of each network over all rows (x and, unless it rebuilds x, y)."""
    size = 1 + networks[0].flat().size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(networks), size + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            y = _matrix(batch.column(1)) if loss == "logistic" else x
            for at in range(0, len(x), ROWS):
                for k, network in enumerate(networks):
                    total[k, 0] += len(x[at : at + ROWS])
                    total[k, 1:] += network.gradient(x[at : at + ROWS], y[at : at + ROWS], loss)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(networks), size + 1), np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(data, np.int64).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    found = rows.mapInArrow(add, "sums binary")
    if found.rdd.getNumPartitions() > 2 * ADDERS:
        found = found.repartition(ADDERS).mapInArrow(join, "sums binary")
    out = np.zeros((len(networks), size + 1), np.int64)
    for row in found.collect():
        out += np.frombuffer(row.sums, np.int64).reshape(out.shape)
    return out


def train(rows: DataFrame, starts: list[Network], loss: str, steps: int, rate: float, rising: bool = False) -> Network:
    """The start of least loss after `steps` steps of Adam; rows are (x[, y]) as arrays of doubles.

    `rising` keeps all weights above zero: with a rising activation the output then rises with every input.
    """
    least = 1.0 / (1 << 9)
    clamp = lambda n: Network([(np.maximum(w, least), b) for w, b in n.layers], n.kind) if rising else n
    networks = [clamp(n) for n in starts]
    first = [np.zeros(n.flat().size) for n in networks]
    second = [np.zeros(n.flat().size) for n in networks]
    best: list[tuple[float, Network]] = [(np.inf, n) for n in networks]
    scale = float(1 << (ACTIVE[0] + ERROR[0]))
    for t in range(1, steps + 2):
        sums = _sums(rows, networks, loss)
        for k, network in enumerate(networks):
            n = max(int(sums[k, 0]), 1)
            cost = int(sums[k, 1]) / (1 << LOSS_BITS) / n
            if cost < best[k][0]:
                best[k] = (cost, network)
            gradient = sums[k, 2:] / scale / n
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.99 * second[k] + 0.01 * gradient**2
            move = rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-9)
            networks[k] = clamp(network.moved(network.flat() - move))
    return min(best, key=lambda b: b[0])[1]
