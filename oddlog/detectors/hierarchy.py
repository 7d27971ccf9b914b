"""Hierarchical density clusters; the score is one minus the strength of membership (Campello et al. 2013).

Rows are joined in order of mutual reachability: the largest of both core distances (to the ``min_samples``-th row, the
row itself counted) and their distance over ``alpha``. Components of fewer than ``min_cluster_size`` rows fall out of
the cluster they leave; one that parts into several of that size ends there. Of a cluster and those inside it, the more
stable choice is kept; the cluster of all rows never is.

Equal reaches join at once, so neither the order of rows nor the choice among equal edges shows. Reaches of zero count as
the least one above zero. Rows of one vector are one point of many rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from oddlog.detectors.base import Fitted, Shared, clean
from oddlog.detectors.neighbours import distance_score, transfer_scores
from oddlog.operators import nearest as nn
from oddlog.operators.order import with_position
from oddlog.operators.spanning import BLOCK_ROWS, TASK_EDGES, climb, known_edges, merge_tree, reach_edges, spanning_tree
from oddlog.session import freeze

_SAME = ["h", "vi", "vv"]


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Clusters at least as stable as the best choice inside them; inner ones have later births."""
    pdf = pdf.sort_values("birth", ascending=False, ignore_index=True)
    place = {c: i for i, c in enumerate(pdf.cluster.tolist())}
    inside, win, best = pdf.inside.to_numpy(copy=True), np.zeros(len(pdf), bool), pdf.stability.to_numpy(copy=True)
    for i, outer in enumerate(pdf.outer.tolist()):
        win[i] = best[i] >= inside[i]
        best[i] = max(best[i], inside[i])
        if outer in place:
            inside[place[outer]] += best[i]
    return pd.DataFrame({"cluster": pdf.cluster, "win": win})


def winners(clusters: DataFrame, bound: int = TASK_EDGES) -> DataFrame:
    """``(cluster, win)`` for ``(cluster, outer, birth, stability)``.

    Clusters whose inner ones are settled go first, round by round, until at most ``bound`` are left to one task.
    """
    open_ = freeze(clusters.select("cluster", F.coalesce("outer", F.lit(-1)).alias("outer"), "birth", "stability", F.lit(0.0).alias("inside")))
    settled = []
    while open_.count() > bound:
        holds = open_.select(F.col("outer").alias("cluster")).distinct()
        ends = freeze(open_.join(holds, "cluster", "left_anti"))
        settled.append(ends.select("cluster", (F.col("stability") >= F.col("inside")).alias("win")))
        sums = ends.groupBy(F.col("outer").alias("cluster")).agg(F.sum(F.greatest("stability", "inside")).alias("more"))
        open_ = freeze(open_.join(ends.select("cluster"), "cluster", "left_anti").join(sums, "cluster", "left").select(
            "cluster", "outer", "birth", "stability", (F.col("inside") + F.coalesce("more", F.lit(0.0))).alias("inside")
        ))
    out = open_.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: _choose(pdf), "cluster long, win boolean")
    for part in settled:
        out = out.unionByName(part)
    return freeze(out)


def memberships(merges: DataFrame, points: DataFrame, n_points: int, n_merges: int, least: int, bound: int = TASK_EDGES) -> DataFrame:
    """``(pid, cluster, strength)`` of the points inside of chosen clusters; a cluster goes by its top node."""
    heavy = points.filter(F.col("size") >= least).select(F.col("pid").alias("node"), F.col("core").alias("w"), "size")
    nodes = freeze(merges.select("node", "w", "size").unionByName(heavy))
    below = merges.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("up"), F.col("w").alias("up_w"))
    known = below.join(nodes.select("node", "w", F.col("size").alias("rows")), "node", "left").join(
        points.select(F.col("pid").alias("node"), "size"), "node", "left"
    )
    below = freeze(known.select("node", "up", "up_w", "w", F.coalesce("rows", "size").alias("size")))
    # Merges of one reach are one: each goes by the topmost.
    run = climb(below.filter("w = up_w"), bound)
    as_one = lambda df, name: df.join(run.select(F.col("node").alias(name), "top"), name, "left").withColumn(name, F.coalesce("top", name)).drop("top")
    links = freeze(as_one(below.filter("w IS NULL OR w <> up_w").select("node", "up", "size"), "up"))
    small = climb(links.filter(F.col("size") < least), bound)
    inner = links.filter(F.col("size") >= least)
    parts = inner.groupBy("up").agg(F.count(F.lit(1)).alias("parts"))
    inner = freeze(inner.join(parts, "up"))
    same = climb(inner.filter("parts = 1"), bound)
    cluster_of = lambda df, name: df.join(same.select(F.col("node").alias(name), "top"), name, "left").withColumn("cluster", F.coalesce("top", name)).drop("top")
    # Where a point falls out: its first merge of enough rows.
    first = points.select("pid", "size", F.col("pid").alias("node")).join(small, "node", "left")
    first = as_one(first.select("pid", "size", F.coalesce("top", "node").alias("at")), "at")
    fate = cluster_of(first, "at").join(nodes.select(F.col("node").alias("at"), "w"), "at")
    fate = freeze(fate.select("pid", "size", "cluster", (1.0 / F.col("w")).alias("leaves")))
    born = inner.filter("parts > 1").select(F.col("node").alias("name"), F.col("up").alias("at"), "size")
    born = cluster_of(born, "at").join(nodes.select(F.col("node").alias("at"), "w"), "at").select(
        "name", F.col("cluster").alias("outer"), "size", (1.0 / F.col("w")).alias("birth")
    )
    root = merges.filter(F.col("node") == n_points + n_merges - 1).select(
        F.col("node").alias("name"), F.lit(None).cast("long").alias("outer"), "size", F.lit(0.0).alias("birth")
    )
    born = freeze(born.unionByName(root))
    leaving = fate.select("cluster", "size", "leaves").unionByName(
        born.filter("outer IS NOT NULL").select(F.col("outer").alias("cluster"), "size", F.col("birth").alias("leaves"))
    ).groupBy("cluster").agg(F.sum(F.col("size") * F.col("leaves")).alias("total"), F.max("leaves").alias("end"))
    clusters = freeze(born.withColumnRenamed("name", "cluster").join(leaving, "cluster").withColumn(
        "stability", F.when(F.col("outer").isNull(), F.lit(float("-inf"))).otherwise(F.col("total") - F.col("size") * F.col("birth"))
    ))
    won = clusters.join(winners(clusters, bound), "cluster").withColumn("win", F.col("win") & F.col("outer").isNotNull())
    won = freeze(won.select(F.col("cluster").alias("node"), F.col("outer").alias("up"), "win", "end"))
    # The winner at or above a cluster, then the last winner above that.
    near = climb(won.filter("NOT win AND up IS NOT NULL"), bound)
    over = won.filter("win").select("node", "up").join(near.select(F.col("node").alias("up"), "top"), "up", "left")
    over = over.select("node", F.coalesce("top", "up").alias("up")).join(won.filter("win").select(F.col("node").alias("up")), "up")
    last = climb(over, bound)
    chosen = won.select("node").join(near, "node", "left").select(F.col("node").alias("cluster"), F.coalesce("top", "node").alias("node"))
    chosen = chosen.join(last, "node", "left").select("cluster", F.coalesce("top", "node").alias("node"))
    chosen = chosen.join(won.filter("win").select("node", "end"), "node")
    return fate.join(chosen, "cluster").select("pid", F.col("node").alias("cluster"), (F.least("leaves", "end") / F.col("end")).alias("strength"))


class HierarchyModel(Fitted):
    def __init__(self, train: DataFrame, members: DataFrame, k: int):
        self.train, self.members, self.k = train, members, k
        super().__init__(members.select("row_id", "score"))

    def score(self, rows: DataFrame) -> DataFrame:
        return transfer_scores(clean(rows), self.train, self.train_scores, self.k)


class Hierarchy:
    """``members`` of the model: row_id, cluster (its least row id; null for noise) and score.

    Noise scores 1. Tables of fewer rows than ``min_cluster_size``, of one point or without a parting are all noise.
    Settings of a search structure (``algorithm``, ``leaf_size``, ``n_jobs``) change no result and are not used.
    """

    neighbours = 0

    def __init__(self, min_cluster_size: int = 5, min_samples: int | None = None, metric: str = "euclidean", alpha: float = 1.0,
                 block_rows: int | None = None, bound: int = TASK_EDGES, **_search):
        if metric != "euclidean":
            raise ValueError(f"unknown metric {metric!r}")
        if min_cluster_size < 2:
            raise ValueError("a cluster has two rows or more")
        self.least, self.min_samples, self.alpha = min_cluster_size, min_samples or min_cluster_size, alpha
        self.block_rows, self.bound = block_rows, bound

    def points(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
        """Rows by vector, the numbered points (pid, qid, size, core and vector), the neighbour lists, count and width."""
        width = nn.vector_width(rows)
        lists = freeze(nn.nearest(rows, k=self.min_samples, include_self=True, rows_per_side=self.block_rows))
        cores = lists.select(F.col("row_id").alias("id"), distance_score(F.col("nn")).alias("core"))
        hashed = nn.unpacked(rows, "row_id", "features", width).withColumn("h", F.xxhash64("vi", "vv"))
        merged = hashed.join(cores, "id").groupBy(*_SAME).agg(
            F.min("id").alias("qid"), F.count(F.lit(1)).alias("size"), F.min("core").alias("core")
        )
        numbered, n = with_position(merged, ["qid"], "pid")
        return hashed, freeze(numbered), lists, n, width

    def spanning(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """`points` and the edges of their spanning tree."""
        hashed, points, lists, n, width = self.points(clean(rows))
        edges = reach_edges(points, width, self.alpha, self.block_rows, known_edges(lists, points, self.alpha, hashed), max(self.bound, BLOCK_ROWS))
        return hashed, points, spanning_tree(edges, self.bound), n

    def fit(self, rows: DataFrame, shared: Shared | None = None) -> HierarchyModel:
        rows = clean(rows)
        total = rows.count()
        noise = rows.select("row_id", F.lit(None).cast("long").alias("cluster"), F.lit(1.0).alias("score"))
        k = min(self.least, total)
        if total < self.least:
            return HierarchyModel(rows, noise, k)
        hashed, points, tree, n = self.spanning(rows)
        if n < 2:
            return HierarchyModel(rows, noise, k)
        reaches = tree.select("w").unionByName(points.filter("size > 1").select(F.col("core").alias("w")))
        floor = reaches.filter("w > 0").agg(F.min("w")).first()[0] or 1.0
        lifted = lambda name: F.greatest(F.col(name), F.lit(float(floor)))
        points = points.withColumn("core", lifted("core"))
        merges = merge_tree(tree.withColumn("w", lifted("w")), points, n, self.bound)
        found = memberships(merges, points, n, n - 1, self.least, self.bound).join(points, "pid")
        names = found.groupBy("cluster").agg(F.min("qid").alias("name"))
        named = found.join(names, "cluster").select(
            F.col("h").alias("nh"), F.col("vi").alias("ni"), F.col("vv").alias("nv"), F.col("name").alias("cluster"), "strength"
        )
        same = (F.col("h") == F.col("nh")) & (F.col("vv") == F.col("nv")) & F.col("vi").eqNullSafe(F.col("ni"))
        members = freeze(hashed.join(named, same, "left").select(
            F.col("id").alias("row_id"), "cluster", F.coalesce(1.0 - F.col("strength"), F.lit(1.0)).alias("score")
        ))
        return HierarchyModel(rows, members, k)
