"""Neighbour lists by way of boxes against brute force."""

import numpy as np
import pytest

from oddlog.operators import nearest as nn
from oddlog.operators.boxes import Boxes, reached
from tests.test_detectors import brute, frame, lists


def test_boxes_part_all_points_evenly():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(3900, 2)), rng.normal(size=(100, 2)) * 1e6])
    boxes = Boxes(x, 40)
    home = boxes.of(x)
    assert len(boxes) == 40 and np.bincount(home, minlength=40).max() < 2.2 * 100
    assert all((boxes.inside(x[home == b], b) >= 0).all() for b in range(40))
    assert (x < boxes.high[home]).all() and (x >= boxes.low[home]).all()
    ties = np.repeat([[0.0, 0.0], [0.0, 1.0]], [90, 10], axis=0)
    assert len(Boxes(ties, 8)) == 2 and len(Boxes(np.ones((30, 2)), 8)) == 1 and len(Boxes(np.zeros((0, 2)), 8)) == 1


def test_reached_boxes():
    low, high = np.array([[0.0, 0.0], [2.0, 0.0], [5.0, 5.0]]), np.array([[1.0, 1.0], [3.0, 1.0], [6.0, 6.0]])
    point, box = reached(np.array([[1.5, 0.5], [0.0, 0.0]]), np.array([0.5, np.inf]), low, high, 2)
    assert sorted(zip(point.tolist(), box.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


def points(kind):
    rng = np.random.default_rng(2)
    if kind == "ties":
        return rng.integers(0, 8, size=(250, 2)).astype(float)
    x = rng.normal(size=(250, 2))
    x[::50] *= 1000.0
    return x


@pytest.mark.parametrize("kind", ["far", "ties"])
def test_lists_by_boxes_equal_brute_force(spark, kind):
    x = points(kind)
    assert lists(nn.nearest(frame(spark, x), k=5, rows_per_side=20)) == brute(x, range(len(x)), x, range(len(x)), 5, True)
    q = x * 1.5 + 2
    assert lists(nn.nearest(frame(spark, q), frame(spark, x), 5, rows_per_side=20)) == brute(q, range(len(q)), x, range(len(x)), 5, False)


def test_few_features_do_not_meet_in_pairs(spark):
    """A query comes back with a list of its box; those that all boxes may hold are left to the pairs."""
    def of(q, x):
        asked = nn.unpacked(frame(spark, q), "row_id", "features", 2).selectExpr("*", "true AS is_query", "false AS is_base")
        held = nn.unpacked(frame(spark, x), "row_id", "features", 2).selectExpr("*", "false AS is_query", "true AS is_base")
        vectors = nn._distinct(asked.unionByName(held), 6, False).select("h", "vi", "vv", "ids", "qid").localCheckpoint()
        return nn._by_boxes(vectors, 5, 2, False, 20)

    x = points("far")
    assert of(x + 0.01, x).count() == len(x)
    turn = np.linspace(0, 2 * np.pi, 900, endpoint=False)
    assert of(np.random.default_rng(3).normal(0, 1e-3, (60, 2)), np.c_[np.cos(turn), np.sin(turn)]) is None
