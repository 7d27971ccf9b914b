"""Embedding whitening from an exact scatter matrix, counted on bit planes.

Entries become whole numbers. The bits of each dimension, shifted by its least value, are packed across rows into 64-bit
words, a plane for each bit; the product sum of two dimensions is the popcount of the AND of their planes, weighed by
2 ** (p + q). Counts are kept by p + q, so no sum can leave 64 bits before they are put together as Python integers.
The matrix is centred as integers (n * products - sums * sums) and only then divided and given to eigh. Tasks send a
table whose size depends on dimensions alone, in rows that are summed as they stream by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.llm.common import shuffle_parts

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
COMPONENTS = 32
ROWS = 4096  # rows packed at once
FAR = float(1 << 62)  # entries beyond are taken as this


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float


def whole(vector: Column) -> Column:
    """x-vector of an embedding; null where the vector is null, empty or has a null or non-finite entry."""
    v = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), c * SCALE))).cast("long") + SHIFT)
    return F.when((F.size(v) > 0) & ~bad, x)


def rows_of(embeddings: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that remain, and their width: the most common one, the larger of equals."""
    x = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), whole(F.col(f"`{vector_col}`")).alias("x")).filter("x IS NOT NULL")
    widths = x.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths["width"] if widths else 0
    return x.filter(F.size("x") == width), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _stream_sum(rows: DataFrame, kind: type, parts: int) -> dict[int, np.ndarray]:
    """Sums of the arrays (at, binary) of all tasks, by `at`; a task holds the sums of its own keys only."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(data, kind)
                total[at] = total[at] + values if at in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["at", "data"])

    out = rows.repartition(parts, "at").mapInArrow(add, "at int, data binary").collect()
    return {r["at"]: np.frombuffer(r["data"], kind) for r in out}


def planes(x: np.ndarray, low: np.ndarray, of: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """A row of packed words for each plane: bit `bit` of dimension `of`, less the dimension's least value."""
    y = (x - low).view(np.uint64)
    bits = ((y.T[of] >> bit[:, None].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -len(x) % 64))), axis=1)
    return packed.view(np.uint64)


def scatter(rows: DataFrame, low: list[int], high: list[int]) -> list[list[int]]:
    """Exact sums of (x_i - low_i) * (x_j - low_j) over all rows."""
    width, lows = len(low), np.array(low, np.int64)
    bits = [(h - l).bit_length() for l, h in zip(low, high)]
    of = np.repeat(np.arange(width), bits)
    bit = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if len(of) else np.zeros(0, np.int64)
    powers = max(1, 2 * max(bits) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((width, width, powers), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for start in range(0, len(x), ROWS):
                words = planes(x[start : start + ROWS], lows, of, bit)
                for k in range(len(of)):
                    met = np.bitwise_count(words & words[k]).sum(1, dtype=np.int64)
                    found[of[k], of, bit[k] + bit] += met
        held = np.flatnonzero(found.any((1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([found[i].tobytes() for i in held], pa.binary())], ["at", "data"])

    parts = min(width, shuffle_parts(rows.sparkSession))
    sums = _stream_sum(rows.select("x").mapInArrow(count, "at int, data binary"), np.int64, parts)
    out = [[0] * width for _ in range(width)]
    for i, data in sums.items():
        table = data.reshape(width, powers)
        out[i] = [sum(int(c) << w for w, c in enumerate(line) if c) for line in table]
    return out


def fit(rows: DataFrame, width: int) -> Whitening | None:
    """Eigenvectors of the covariance of all x-vectors; None without rows."""
    if not width:
        return None
    at = [F.get("x", F.lit(k)) for k in range(width)]
    # Sums may pass 64 bits, so they are decimals.
    found = rows.agg(F.count(F.lit(1)), *[f(a) for f in (F.min, F.max, lambda a: F.sum(a.cast("decimal(20,0)"))) for a in at]).first()
    n, low, high, sums = found[0], found[1 : width + 1], found[width + 1 : 2 * width + 1], [int(s) for s in found[2 * width + 1 :]]
    products = scatter(rows, list(low), list(high))
    shifted = [s - n * l for s, l in zip(sums, low)]
    centred = [[n * products[i][j] - shifted[i] * shifted[j] for j in range(width)] for i in range(width)]
    covariance = np.array([[c / (n * n) for c in line] for line in centred])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[lead, np.arange(width)] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(covariance)))


def _projector(model: Whitening, components: int):
    """Function from an x matrix to its whitened rows (0 along a component without spread)."""
    base = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    e = model.values[:components]
    live = e > model.trace * 1e-13
    scale = np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), 0.0)
    basis = model.vectors[:, :components] * scale
    return (lambda x: ((x - base).astype(np.float64) - rest) @ basis), live


def identity_error(rows: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    project, live = _projector(model, components)
    width = len(model.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components))
        for batch in batches:
            w = project(_matrix(batch.column(0), width))
            total[:components] += w.T @ w
            total[components] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(components + 1), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["at", "data"])

    parts = min(components + 1, shuffle_parts(rows.sparkSession))
    sums = _stream_sum(rows.select("x").mapInArrow(add, "at int, data binary"), np.float64, parts)
    mean = sums[components] / model.n
    covariance = np.array([sums[i] for i in range(components)]) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(components))[np.ix_(live, live)].max(initial=0.0))


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of (n * x - S) ** 2, exact; null beyond 64 bits."""
    base = np.array([s // model.n for s in model.sums], np.int64)
    rest = [s % model.n for s in model.sums]
    near = x - base
    if model.n * (int(np.abs(near).max(initial=0)) + 1) < 1 << 28 and x.shape[1] < 64:
        t = near * model.n - np.array(rest, np.int64)
        return pa.array((t * t).sum(1))
    t = near.astype(object) * model.n - np.array(rest, object)
    return pa.array([v if v < 1 << 63 else None for v in (t * t).sum(1)], pa.int64())


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component.

    Rows whose vector is null, empty or has a null or non-finite entry go, and rows of another width than the most
    common one (the larger of equally common ones). Rows that repeat an id or a vector are rows of their own; a null id
    stays. A component without spread (all vectors equal along it) has whitened 0 and is left out of identity_error;
    if no dimension spreads, explained is 0. Components end at the width. Other columns are not looked at. An empty
    table gives an empty result.
    """
    rows, width = rows_of(embeddings, id_col, vector_col)
    model = fit(rows, width)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], OUT)
    k = min(components, width)
    error = identity_error(rows, model, k)
    project, _ = _projector(model, k)
    explained = model.values[:k] / model.trace if model.trace else np.zeros(k)
    names = [c.split()[0] for c in OUT.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = _matrix(part.column(1), width)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)), deviations(x, model).take(each),
                     pa.array(project(x).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names
                )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(read, OUT)
