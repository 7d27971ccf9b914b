"""Hierarchical density clusters against thresholds by brute force."""

import numpy as np
import pytest

from oddlog.detectors.hierarchy import Hierarchy, winners
from oddlog.operators import nearest as nn
from oddlog.operators.spanning import _in_order, _prim, climb, known_edges, reach_edges, spanning_tree
from oddlog.plans.catalog import QUERIES
from tests.test_detectors import components_by_hand, frame


def reach(x, k, alpha=1.0):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(k, len(x)) - 1]
    return np.maximum(np.maximum(d / alpha, core[:, None]), core[None, :]), core


def parts_of(members, w, level):
    """Components of ``members`` under reaches of at most ``level``; a row that reaches no other is one alone."""
    left, out = set(members), []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            todo += [j for j in left if j not in seen and w[i, j] <= level]
        out.append(sorted(seen))
        left -= seen
    return out


def by_hand(x, m, k, alpha=1.0):
    """Label and strength of each row: thresholds are lowered one by one and every component is followed."""
    w, core = reach(x, k, alpha)
    pairs = w[~np.eye(len(x), dtype=bool)]
    floor = pairs[pairs > 0].min() if (pairs > 0).any() else 1.0
    w = np.maximum(w, floor)
    # Components change at the weights of a spanning tree only.
    label, levels = list(range(len(x))), set()
    for a, b in sorted(zip(*np.triu_indices(len(x), 1)), key=lambda e: w[e]):
        if label[a] != label[b]:
            label = [label[b] if v == label[a] else v for v in label]
            levels.add(w[a, b])
    levels = sorted(levels, reverse=True)

    def follow(members, level_at, birth):
        leaves, inner = {}, []
        here = members
        for at in range(level_at, len(levels)):
            lam = 1 / levels[at]
            lower = levels[at + 1] if at + 1 < len(levels) else 0.0
            parts = parts_of(here, w, lower)
            big = [p for p in parts if len(p) >= m]
            leaves |= {i: lam for p in parts if len(p) < m for i in p}
            if len(big) == 1:
                here = big[0]
                continue
            inner = [follow(p, at + 1, lam) for p in big]
            leaves_all = list(leaves.values()) + [lam for p in big for _ in p]
            return {"rows": members, "leaves": leaves, "inner": inner, "end": max(leaves_all), "stab": sum(v - birth for v in leaves_all)}
        raise AssertionError("a component of one row is below any size")

    def choose(c, is_root):
        best, names = zip(*[choose(i, False) for i in c["inner"]]) if c["inner"] else ((), ())
        if not is_root and c["stab"] >= sum(best):
            return c["stab"], [c]
        return sum(best), [n for ns in names for n in ns]

    def strengths(c, end):
        out = {i: min(v, end) / end for i, v in c["leaves"].items()}
        for i in c["inner"]:
            out |= strengths(i, end)
        return out

    result = {i: (None, 1.0) for i in range(len(x))}
    for c in choose(follow(list(range(len(x))), 0, 0.0), True)[1]:
        result |= {i: (min(c["rows"]), 1 - s) for i, s in strengths(c, c["end"]).items()}
    return result


def clouds(seed, dims=2, grid=None):
    rng = np.random.default_rng(seed)
    centres = rng.random((5, dims)) * 12
    x = np.concatenate([c + rng.normal(0, s, (24, dims)) for c, s in zip(centres, (0.2, 0.4, 0.6, 0.3, 0.9))] + [rng.random((12, dims)) * 14])
    x = x[rng.permutation(len(x))]
    if grid:
        x = np.round(x * grid) / grid
    return x


def check(spark, x, m, k, **options):
    model = Hierarchy(m, k, **options).fit(frame(spark, x))
    got = {r.row_id: (r.cluster, r.score) for r in model.members.collect()}
    want = by_hand(x, m, k, options.get("alpha", 1.0))
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert {i: s for i, (_, s) in got.items()} == pytest.approx({i: s for i, (_, s) in want.items()}, abs=1e-9)
    return got


@pytest.mark.parametrize("seed, grid, m, k", [(1, None, 5, 5), (2, 2, 6, 3), (3, 1, 4, 1)])
def test_members_equal_brute_force(spark, seed, grid, m, k):
    """Clouds; on a grid reaches tie and rows repeat."""
    got = check(spark, clouds(seed, grid=grid), m, k)
    assert len({c for c, _ in got.values() if c is not None}) > 1


def test_rounds_equal_one_task(spark):
    """With bounds of a few rows every step goes by rounds over tasks."""
    check(spark, clouds(4, grid=3)[:60], 4, 3, block_rows=20, bound=40)


def test_alpha_changes_reach(spark):
    check(spark, clouds(5)[:60], 4, 2, alpha=0.5)


def test_hot_copies(spark):
    """A third of all rows share one vector: a cluster at once, whose rows are full members."""
    x = clouds(6)
    x[: len(x) // 3] = x[0]
    got = check(spark, x, 5, 5)
    assert len({got[i] for i in range(len(x) // 3)}) == 1 and got[0][1] == 0.0


@pytest.mark.parametrize("x", [np.zeros((0, 2)), np.zeros((3, 2)), np.ones((40, 2)), np.arange(4.0)[:, None]])
def test_nothing_to_part_is_noise(spark, x):
    rows = frame(spark, x) if len(x) else frame(spark, np.zeros((1, 2))).filter("false")
    got = Hierarchy(5).fit(rows).members.collect()
    assert len(got) == len(x) and all(r.cluster is None and r.score == 1.0 for r in got)


def test_tree_by_rounds_has_least_weight(spark):
    rng = np.random.default_rng(7)
    pairs = {(int(min(a, b)), int(max(a, b))): float(w) for a, b, w in zip(rng.integers(0, 60, 700), rng.integers(0, 60, 700), rng.integers(1, 30, 700))}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, w double")
    label, want = list(range(60)), []
    for (a, b), w in sorted(pairs.items(), key=lambda e: e[1]):
        if label[a] != label[b]:
            label, want = [label[b] if v == label[a] else v for v in label], [*want, w]
    for bound in (4, 1 << 20):
        assert sorted(r.w for r in spanning_tree(edges, bound).collect()) == want


def test_climb_and_winners_by_rounds(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 7)], "node long, up long")
    for bound in (0, 1000):
        assert {r.top for r in climb(links, bound).collect()} == {50}
    tree = spark.createDataFrame([(0, None, 0.0, float("-inf")), (1, 0, 1.0, 3.0), (2, 0, 1.0, 9.0), (3, 1, 2.0, 2.0), (4, 1, 2.0, 2.5), (5, 2, 2.0, 1.0), (6, 2, 2.0, 1.0)],
                                 "cluster long, outer long, birth double, stability double")
    for bound in (0, 1000):
        assert {r.cluster for r in winners(tree, bound).collect() if r.win} == {2, 3, 4, 5, 6}


def test_parts_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/part.parquet").orderBy("p_partkey").select("p_partkey", "p_size", "p_retailprice").collect()
    want = by_hand(np.array([[float(r.p_size), float(r.p_retailprice) / 50] for r in rows]), 5, 5)
    keys = [r.p_partkey for r in rows]
    got = {r.row_id: (r.cluster, r.score) for r in QUERIES["hierarchy_part"](spark, folder).collect()}
    assert got == {keys[i]: (None if c is None else keys[c], pytest.approx(s, abs=1e-6)) for i, (c, s) in want.items()}
    assert any(c is not None for c, _ in got.values())


def test_new_rows_take_scores_of_near_ones(spark):
    x = clouds(8)
    model = Hierarchy(5).fit(frame(spark, x))
    known = {r.row_id: r.score for r in model.members.collect()}
    got = {r.row_id: r.score for r in model.score(frame(spark, x[:10])).collect()}
    assert all(got[i] == pytest.approx(known[i], abs=1e-6) for i in range(10))


def test_pairs_of_blocks_leave_few_edges(spark):
    x = np.random.default_rng(5).normal(size=(400, 3)) + 1e6
    x[:40] = x[40:80] + 1e-7
    w, core = reach(x, 4)
    points = spark.createDataFrame([(i, None, r.tolist(), float(c)) for i, (r, c) in enumerate(zip(x, core))], "pid long, vi array<int>, vv array<double>, core double")
    edges = reach_edges(points, 3, block_rows=20)
    _, _, want = _prim(x, core, 1.0)
    assert edges.count() < 400 * 400 / 20
    assert sorted(r.w for r in spanning_tree(edges).collect()) == pytest.approx(sorted(want), rel=1e-9)
    at, left, total = 0, set(range(1, 400)), []
    best = w[0].copy()
    while left:
        at = min(left, key=lambda i: best[i])
        total.append(best[at])
        left.remove(at)
        best = np.minimum(best, w[at])
    assert sorted(want) == pytest.approx(sorted(total), rel=1e-9)


def many_points(spark, x, k):
    """Points and the neighbour lists of rows, as the hierarchy makes them of rows without copies."""
    _, core = reach(x, k)
    points = spark.createDataFrame(
        [(i, i, None, r.tolist(), float(c)) for i, (r, c) in enumerate(zip(x, core))], "pid long, qid long, vi array<int>, vv array<double>, core double"
    )
    return points, nn.nearest(frame(spark, x), k=k, include_self=True, rows_per_side=40)


def odd_clouds(kind):
    rng = np.random.default_rng(11)
    if kind == "apart":
        return np.concatenate([rng.normal(c, 0.1, (50, 3)) for c in (0, 5, 40, 1000, 3e5)])
    if kind == "offset":
        return rng.normal(size=(250, 3)) + 1e6
    if kind == "ties":
        return np.array([(a, b, c) for a in range(7) for b in range(6) for c in range(6)], float)
    return rng.normal(size=(250, 3))


@pytest.mark.parametrize("kind", ["plain", "apart", "offset", "ties"])
@pytest.mark.parametrize("bound", [1 << 20, 100])
def test_order_of_known_edges_keeps_the_tree(spark, kind, bound):
    """Beyond the bound points have no order, and each pair of tiles leaves a tree."""
    x = odd_clouds(kind)
    points, lists = many_points(spark, x, 4)
    edges = reach_edges(points, 3, block_rows=20, known=known_edges(lists, points), bound=bound)
    got = sorted(r.w for r in spanning_tree(edges).collect())
    assert len(got) == len(x) - 1
    assert got == pytest.approx(sorted(_prim(x, reach(x, 4)[1], 1.0)[2]), rel=1e-9)


def test_known_edges_leave_few_pairs(spark):
    x = odd_clouds("plain")
    points, lists = many_points(spark, x, 4)
    edges = reach_edges(points, 3, block_rows=20, known=known_edges(lists, points)).count()
    assert edges < 1.2 * len(x) < reach_edges(points, 3, block_rows=20).count()


def test_ids_of_several_vectors_name_no_point(spark):
    points, lists = many_points(spark, odd_clouds("plain")[:60], 4)
    rows = spark.createDataFrame([(i, i * 7) for i in range(60)] + [(3, 99), (5, 35)], "id long, h long")
    ends = lambda df: {p for r in df.collect() for p in (r.a, r.b)}
    assert 3 in ends(known_edges(lists, points)) and ends(known_edges(lists, points, rows=rows)) == ends(known_edges(lists, points)) - {3}


def test_largest_gap_is_the_largest_edge_on_the_way():
    w, _ = reach(np.random.default_rng(3).normal(size=(40, 2)), 3)
    a, b = np.triu_indices(40, 1)
    pid, gap, tree = _in_order(a, b, w[a, b], 40)
    way = w.copy()
    for k in range(40):
        way = np.minimum(way, np.maximum(way[:, k : k + 1], way[k]))
    assert sorted(pid) == list(range(40)) and not tree.any() and gap[-1] == np.inf
    assert all(gap[i:j].max() == way[pid[i], pid[j]] for i in range(40) for j in range(i + 1, 40))
    pid, gap, tree = _in_order(np.array([0, 2]), np.array([1, 3]), np.array([1.0, 2.0]), 5)
    assert sorted(zip(tree.tolist(), pid.tolist())) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)]
    assert sorted(gap) == [1.0, 2.0, np.inf, np.inf, np.inf]


def test_hierarchy_by_stored_blocks_equals_brute_force(spark):
    """More points than the blocks whose copies are shuffled; rows repeat and reaches tie."""
    x = np.concatenate([clouds(9, grid=4), clouds(10, grid=4) + 30])
    check(spark, x, 6, 3, block_rows=16)


def test_blocks_are_read_and_not_copied(spark):
    x = np.random.default_rng(12).normal(size=(300, 2))
    text = nn.nearest(frame(spark, x), k=3, rows_per_side=20)._jdf.queryExecution().toString()
    assert "CartesianProduct" in text and "Generate" not in text
