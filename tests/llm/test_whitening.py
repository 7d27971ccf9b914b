"""Whitening against numpy on the same whole numbers."""

import math

import numpy as np
import pytest

from oddlog.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, x string, n int"


def frame(spark, vectors, ids=None):
    rows = [(k if ids is None else ids[k], v, "x", 1) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def whole(vectors):
    return [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]


def test_planes_give_exact_products():
    rng = np.random.default_rng(0)
    x = rng.integers(-(10**6), 10**6, (130, 3))
    x[:, 2] = 7  # no bits at all
    low, high = x.min(0), x.max(0)
    bits = [int(h - l).bit_length() for l, h in zip(low, high)]
    of = np.repeat(np.arange(3), bits)
    bit = np.concatenate([np.arange(b) for b in bits])
    words = wh.planes(x, low, of, bit)
    y = (x - low).astype(object)
    for i in range(2):
        for j in range(2):
            total = sum(int(np.bitwise_count(words[a] & words[b]).sum()) << int(bit[a] + bit[b]) for a in np.flatnonzero(of == i) for b in np.flatnonzero(of == j))
            assert total == int((y[:, i] * y[:, j]).sum())


@pytest.mark.parametrize("spread", [0.5, 1e4, 1e13])
def test_against_numpy(spark, spread):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) * spread).tolist()
    vectors += vectors[:4]  # repeated rows count as often as they stand
    got = wh.whiten(frame(spark, vectors), components=4).toPandas()
    x = np.array(whole(vectors), object)
    n, s = len(x), x.sum(0)
    t = n * x - s
    deviation = (t * t).sum(1)
    covariance = np.array([[sum(a * b for a, b in zip(t[:, i], t[:, j])) / n**3 for j in range(5)] for i in range(5)], float)
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    centred = np.array([[a / n for a in row] for row in t], float)
    assert len(got) == 4 * n and set(got.n) == {n}
    for row in got.itertuples():
        k = row.component - 1
        want = centred[row.vec_id] @ vectors_[:, k] / math.sqrt(values[k])
        assert math.isclose(abs(row.whitened), abs(want), rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(row.explained, values[k] / np.trace(covariance), rel_tol=1e-9)
        if deviation[row.vec_id] < 2**63:
            assert row.deviation == deviation[row.vec_id]
        else:
            assert math.isnan(row.deviation)  # beyond 64 bits: null
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(white.T @ white / n - np.eye(4)).max() < 1e-8 and got.identity_error.max() < 1e-8 and got.identity_error.nunique() == 1


def test_odd_rows(spark):
    good = [[0.1, 0.2], [0.3, -0.4], [0.3, -0.4], [1.0, 2.0]]
    bad = [None, [], [None, 1.0], [float("nan"), 0.0], [0.0, float("inf")], [1.0, 2.0, 3.0]]
    ids = [1, 2, 2, None, 5, 6, 7, 8, 9, 10]
    got = wh.whiten(frame(spark, good + bad, ids)).collect()
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted([(i, c) for i in (1, 2, 2, None) for c in (1, 2)], key=repr)
    assert {r.n for r in got} == {4}
    assert wh.whiten(frame(spark, [])).count() == 0 and wh.whiten(frame(spark, bad[:2])).count() == 0
    same = wh.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(0.0, 0.0, 0, 0.0)}
