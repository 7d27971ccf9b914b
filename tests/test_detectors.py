
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, SparseVector


from oddlog.detectors import ECOD, IForest, KNN, LOF, LUNAR, Density, Reconstruction
from oddlog.detectors.base import Shared, cuts
from oddlog.detectors.density import _close, cluster_roots
from oddlog.detectors.neighbours import transfer_scores
from oddlog.operators import ecdf, nearest as nn
from oddlog.operators.descent import _hopeless, descend
from oddlog.operators.nearest import nearest


def frame(spark, x, ids=None, sparse=False):
    ids = range(len(x)) if ids is None else ids
    make = (lambda r: SparseVector(len(r), [(i, float(v)) for i, v in enumerate(r) if v])) if sparse else Vectors.dense
    return spark.createDataFrame([(int(i), make(r)) for i, r in zip(ids, x)], ["row_id", "features"])


def brute(q, qid, x, xid, k, skip_self):
    out = {}
    for v, i in zip(q, qid):
        d = np.sqrt(((x - v) ** 2).sum(1))
        ranked = sorted((round(float(a), 9), int(j)) for a, j in zip(d, xid) if not (skip_self and j == i))
        out[int(i)] = ranked[:k]
    return out


def lists(df):
    return {r.row_id: [(round(e.dist, 9), e.id) for e in r.nn] for r in df.collect()}


def cloud(n=300, d=4, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(np.concatenate([rng.normal(c, 0.4, (n // 3, d)) for c in (0, 3, 7)]) * 8) / 8
    if copies:
        x[:copies] = x[0]
    return x


@pytest.mark.parametrize("copies", [0, 110])
@pytest.mark.parametrize("include_self", [False, True])
def test_blocked_neighbours_equal_brute_force(spark, copies, include_self):
    x = cloud(copies=copies)
    ids = np.random.default_rng(5).permutation(len(x)) + 10
    df = frame(spark, x, ids)
    got = lists(nearest(df, k=6, include_self=include_self, rows_per_side=16))
    assert got == brute(x, ids, x, ids, 6, not include_self)


def test_groups_and_sparse_vectors_do_not_change_results(spark):
    rng = np.random.default_rng(2)
    x = (rng.random((90, 300)) < 0.01) * rng.integers(1, 4, (90, 300)).astype(float)
    want = brute(x, range(90), x, range(90), 4, True)
    assert lists(nearest(frame(spark, x, sparse=True), k=4)) == want
    assert lists(nearest(frame(spark, x, sparse=True), k=4, rows_per_side=10)) == want
    assert lists(nearest(frame(spark, x), k=4, rows_per_side=10)) == want


@pytest.mark.parametrize("rows_per_side", [None, 12])
def test_queries_against_another_table(spark, rows_per_side):
    x, q = cloud(240, seed=1), cloud(90, seed=3)
    q[:40] = x[3]
    got = lists(nearest(frame(spark, q), frame(spark, x), 5, rows_per_side=rows_per_side))
    assert got == brute(q, range(len(q)), x, range(len(x)), 5, False)


def test_descent_finds_nearly_all_lists(spark):
    x = cloud(700, copies=50)
    df = frame(spark, x)
    want = lists(nearest(df, k=5))
    found = descend(df, k=5)
    got = lists(found.lists)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    recall = np.mean([len({d for d, _ in got[r]} & {d for d, _ in want[r]}) / len({d for d, _ in want[r]}) for r in want])
    assert recall > 0.9 and found.recall > 0.9
    alone = descend(frame(spark, np.ones((1, 3))), k=2)
    assert [r.nn for r in alone.lists.collect()] == [[]] and alone.recall == 1.0


def test_descent_measures_fewer_pairs_a_row(spark):
    few, many = (descend(frame(spark, np.random.default_rng(2).normal(size=(n, 6))), k=5) for n in (600, 2400))
    assert many.recall > 0.9 and many.measured / 2400 < 2 * few.measured / 600 and many.measured < 2400 * 2399 / 2


def test_descent_ends_with_exact_lists_where_distances_hardly_differ(spark):
    df = frame(spark, np.random.default_rng(3).normal(size=(1200, 64)))
    few = descend(df, k=5, extra=1)
    assert few.recall < 0.9
    found = descend(df, k=5, extra=1, least=0.9)
    assert found.recall == 1.0 and lists(found.lists) == lists(nearest(df, k=5))
    assert _hopeless([0.2, 0.5, 0.52], 0.9) and not _hopeless([0.2, 0.3, 0.5], 0.9) and not _hopeless([0.5, 0.9, 0.91], 0.9)


def test_cells_hold_little_beside_their_rows():
    assert nn.side_rows(64) * 64 * 8 <= 16 << 20
    x = np.random.default_rng(4).normal(size=(4096, 8))
    tracemalloc.start()
    pairs = sum(len(rows) for rows, _, _ in nn._close_pairs(x, x, np.full(4096, 5), np.full(4096, -1)))
    links = sum(len(a) for a, _ in _close(x, x, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs >= 5 * 4096 and links >= 4096 and peak < 40 << 20


def test_forest_scores_a_single_split_on_all_cores(spark):
    model = IForest(n_estimators=5).fit(frame(spark, cloud(60)).coalesce(1))
    assert model.train_scores.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fewer_rows_than_neighbours(spark):
    x = np.array([[0.0], [1.0], [3.0]])
    assert lists(nearest(frame(spark, x), k=5)) == brute(x, range(3), x, range(3), 5, True)


@pytest.mark.parametrize("method,want", [("largest", 3.0), ("mean", 2.0), ("median", 2.0)])
def test_knn_methods(spark, method, want):
    x = np.array([[0.0], [1.0], [2.0], [3.0], [50.0]])
    got = dict(KNN(3, method).fit(frame(spark, x)).train_scores.collect())
    assert got[0] == pytest.approx(want)


def test_lof_definition(spark):
    x = cloud(60, 2, seed=4)
    x = x + np.random.default_rng(1).normal(0, 0.01, x.shape)
    k, n = 5, len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nb = np.argsort(d, axis=1)[:, :k]
    kd = np.sort(d, axis=1)[:, k - 1]
    lrd = np.array([1 / (np.maximum(d[i, nb[i]], kd[nb[i]]).mean() + 1e-10) for i in range(n)])
    want = np.array([lrd[nb[i]].mean() / lrd[i] for i in range(n)])
    model = LOF(k).fit(frame(spark, x))
    got = dict(model.train_scores.collect())
    assert [got[i] for i in range(n)] == pytest.approx(want.tolist())
    assert model.score(frame(spark, x[:3] + 20)).count() == 3


def test_one_graph_serves_every_k(spark):
    x = cloud(60)
    shared = Shared(frame(spark, x), k=8)
    small = dict(KNN(3).fit(shared.features, shared).train_scores.collect())
    assert shared.k == 8
    assert small == pytest.approx(dict(KNN(3).fit(frame(spark, x)).train_scores.collect()))
    shared.release()


def ecod_by_hand(x, per_feature=False):
    n = len(x)
    left = -np.log((x[None] <= x[:, None]).sum(1) / n)
    right = -np.log((x[None] >= x[:, None]).sum(1) / n)
    m3 = ((x - x.mean(0)) ** 3).sum(0)
    skew = np.where(m3 < 0, left, right)
    if per_feature:
        return np.maximum(left, right).sum(1)
    return np.maximum.reduce([left.sum(1), right.sum(1), skew.sum(1)])


@pytest.mark.parametrize("sparse,rows", [(False, 0), (True, 0), (True, 1000)])
@pytest.mark.parametrize("per_feature", [False, True])
def test_ecod_definition(spark, sparse, rows, per_feature, monkeypatch):
    monkeypatch.setattr(ecdf, "WINDOW_ROWS", rows)
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 4, (80, 5)) * (rng.random((80, 5)) < 0.4) * 1.0
    x[:, 4] = np.round(rng.exponential(1, 80), 3) + 1
    x[7, :] = 0
    got = dict(ECOD(per_feature).fit(frame(spark, x, sparse=sparse)).train_scores.collect())
    assert [got[i] for i in range(80)] == pytest.approx(ecod_by_hand(x, per_feature).tolist())


def test_ecod_scores_new_rows_within_the_joint_sample(spark):
    x = cloud(60)
    model = ECOD().fit(frame(spark, x[:40]))
    got = dict(model.score(frame(spark, x[40:], range(40, 60))).collect())
    want = ecod_by_hand(x)[40:]
    assert [got[i] for i in range(40, 60)] == pytest.approx(want.tolist())


@pytest.mark.parametrize("bootstrap", [False, True])
def test_forest_invariants(spark, bootstrap):
    x = cloud(600, 3)
    x[5] = 60.0
    df = frame(spark, x)
    model = IForest(30, bootstrap).fit(df)
    got = dict(model.train_scores.collect())
    assert len(got) == len(x) and all(0 < s < 1 for s in got.values())
    assert max(got, key=got.get) == 5
    assert len(model.trees) == 30 and model.sample == 256
    again = dict(IForest(30, bootstrap).fit(df.repartition(7)).train_scores.collect())
    assert got == pytest.approx(again)
    cut = model.cuts([0.1])[0.1]
    share = model.labels(cut).filter("label = -1").count() / len(x)
    assert 0.05 <= share <= 0.1


def test_lunar_ranks_a_far_row_first(spark):
    x = cloud(150, 3, seed=9)
    x[11] = 40.0
    got = dict(LUNAR(5).fit(frame(spark, x)).train_scores.collect())
    assert all(0 <= s <= 1 for s in got.values())
    assert got[11] == pytest.approx(max(got.values()), abs=1e-6)


def test_reconstruction_error(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(100, 2)) @ rng.normal(size=(2, 5)) + 3
    x = base.copy()
    x[4] += np.array([0, 0, 0, 0, 9.0])
    got = dict(Reconstruction(2).fit(frame(spark, x)).train_scores.collect())
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    rest = (x - x.mean(0)) - (x - x.mean(0)) @ v[:2].T @ v[:2]
    assert [got[i] for i in range(100)] == pytest.approx(np.linalg.norm(rest, axis=1).tolist(), abs=1e-6)


def components_by_hand(x, eps):
    label = list(range(len(x)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    changed = True
    while changed:
        changed = False
        for i in range(len(x)):
            low = min(label[j] for j in range(len(x)) if d[i, j] <= eps)
            if low < label[i]:
                label[i], changed = low, True
    return label


@pytest.mark.parametrize("rows_per_side", [None, 10])
def test_cluster_roots_equal_brute_force(spark, rows_per_side):
    x = np.round(np.random.default_rng(3).random((150, 2)) * 64) / 8
    x[:50] = x[0]
    got = dict(cluster_roots(frame(spark, x), 0.7, rows_per_side).collect())
    want = components_by_hand(x, 0.7)
    assert len(got) == len(x)
    assert [got[i] for i in range(len(x))] == want


def test_density_scores(spark):
    x = np.array([[0.0], [0.1], [0.2], [0.3], [5.0], [5.1], [9.0]])
    got = dict(Density(min_cluster_size=3, min_samples=2, eps=0.15).fit(frame(spark, x)).train_scores.collect())
    assert got[4] == got[5] == got[6] == 1.0
    assert all(got[i] == pytest.approx(0.0, abs=1e-6) for i in range(4))


def test_score_transfer(spark):
    train = frame(spark, np.array([[0.0], [1.0], [4.0]]))
    scores = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.5)], "row_id long, score double")
    new = frame(spark, np.array([[0.25]]), [9])
    ((_, got),) = transfer_scores(new, train, scores, 2).collect()
    assert got == pytest.approx((0 / 0.25 + 1 / 0.75) / (1 / 0.25 + 1 / 0.75))


def test_cuts_interpolate(spark):
    scores = spark.createDataFrame([(i, float(i)) for i in range(11)], "row_id long, score double")
    assert cuts(scores, [0.1, 0.25]) == {0.1: pytest.approx(9.0), 0.25: pytest.approx(7.5)}


def test_nan_counts_as_zero(spark):
    x = np.array([[0.0, 1.0], [np.nan, 1.0], [0.0, np.inf], [0.0, 0.0]])
    y = np.nan_to_num(x, nan=0, posinf=0)
    a = dict(ECOD().fit(frame(spark, x)).train_scores.collect())
    b = dict(ECOD().fit(frame(spark, y)).train_scores.collect())
    assert a == pytest.approx(b)
