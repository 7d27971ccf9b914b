"""Density clusters at a fixed cut; rows outside of clusters score highest.

Core distance is the distance to the ``min_samples``-th row, the row itself
counted. Core rows within ``eps`` of each other are one cluster (Campello et
al. 2013, DBSCAN*). Score: 1 for noise, else 1 - least core / own core.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from oddlog.detectors.base import Fitted, Shared, clean
from oddlog.detectors.neighbours import distance_score, transfer_scores
from oddlog.operators import nearest as nn
from oddlog.operators.components import components, local_components
from oddlog.operators.quantile import quantiles
from oddlog.session import freeze, hold


def _close(x: np.ndarray, y: np.ndarray, eps: float):
    """Index pairs at most ``eps`` apart, a million comparisons at a time; borderline ones measured exactly."""
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    slack = 1e-9 * (xx.max(initial=0.0) + yy.max(initial=0.0)) + 1e-12
    step = max(1, nn.HELD // max(len(y), 1))
    for at in range(0, len(x), step):
        d2 = x[at : at + step] @ y.T
        d2 *= -2.0
        d2 += xx[at : at + step, None]
        d2 += yy
        a, b = np.nonzero(d2 <= eps * eps + slack)
        near = np.flatnonzero(d2[a, b] > eps * eps - slack)
        far = near[nn.exact_gaps(x, y, at + a[near], b[near]) > eps]
        yield at + np.delete(a, far), np.delete(b, far)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a and b; only pairs of different groups are kept at a time."""
    a, b = root[a], root[b]
    apart = a != b
    a, b = np.divmod(np.unique(a[apart].astype("int64") * len(root) + b[apart]), max(len(root), 1))
    return local_components(len(root), a, b)[root] if len(a) else root


def cluster_roots(core: DataFrame, eps: float, rows_per_side: int | None = None) -> DataFrame:
    """``(row_id, root)``: rows linked by steps of at most ``eps`` share a root.

    Points are dealt into blocks by hash. A block settles its own links; two
    blocks exchange one link per pair of touching local groups, never their
    row pairs. A point crosses the network once for each block.
    """
    width = nn.vector_width(core)
    rows = nn.unpacked(core, "row_id", "features", width)
    # Copies are one point; it goes by its least row id.
    hashed = rows.withColumn("h", F.xxhash64("vi", "vv"))
    points = freeze(hashed.groupBy("h", "vi", "vv").agg(F.min("id").alias("qid")))
    cores = core.sparkSession.sparkContext.defaultParallelism
    blocks = nn.cut(points.count(), rows_per_side or nn.side_rows(width), cores)

    def own(part: pa.Table) -> pa.Table:
        part = part.sort_by("qid")
        x = nn.arrow_matrix(part["vi"], part["vv"], width)
        root = np.arange(len(part))
        for a, b in _close(x, x, eps):
            root = _merge(root, a, b)
        local = pa.array(part["qid"].to_numpy()[root], pa.int64())
        # Entries that may be null, as the names of the schema say.
        vv = part["vv"].cast(pa.list_(pa.field("element", pa.float64())))
        return part.set_column(part.column_names.index("vv"), "vv", vv).append_column("local", local)

    local = freeze(points.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(
        own, "h long, vi array<int>, vv array<double>, qid long, block int, local long"
    ))

    def links(part: pa.Table) -> pa.Table:
        mine, theirs = (part.filter(pc.equal(part["block"], part[side])) for side in ("low", "high"))
        names, code = np.unique(np.concatenate([mine["local"].to_numpy(), theirs["local"].to_numpy()]), return_inverse=True)
        root = np.arange(len(names))
        x, y = (nn.arrow_matrix(t["vi"], t["vv"], width) for t in (mine, theirs))
        for a, b in _close(x, y, eps):
            root = _merge(root, code[a], code[len(mine) + b])
        # One link per group to the least group it touches: a spanning forest.
        moved = names[root] != names
        return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(names[root][moved], pa.int64())})

    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = local.select("block", "local", "vi", "vv", other.alias("other")).filter("block <> other").select(
        "block", "local", "vi", "vv", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    joined = components(pairs.groupBy("low", "high").applyInArrow(links, "a long, b long"))
    roots = local.join(joined.withColumnRenamed("node", "local"), "local", "left").select(
        "h", "vi", "vv", F.coalesce("root", "local").alias("root")
    )
    same = (hashed.h == roots.h) & (hashed.vv == roots.vv) & hashed.vi.eqNullSafe(roots.vi)
    return hashed.join(roots, same).select(F.col("id").alias("row_id"), "root")


class DensityModel(Fitted):
    def __init__(self, train: DataFrame, scores: DataFrame, k: int):
        self.train, self.k = train, k
        super().__init__(scores)

    def score(self, rows: DataFrame) -> DataFrame:
        return transfer_scores(clean(rows), self.train, self.train_scores, self.k)


class Density:
    """``eps`` defaults to the 0.9 quantile of the core distances."""

    neighbours = 0

    def __init__(self, min_cluster_size: int = 5, min_samples: int | None = None, eps: float | None = None,
                 rows_per_side: int | None = None):
        self.min_cluster_size, self.min_samples = min_cluster_size, min_samples or min_cluster_size
        self.eps, self.rows_per_side = eps, rows_per_side

    def fit(self, rows: DataFrame, shared: Shared | None = None) -> DensityModel:
        rows = clean(rows)
        lists = nn.nearest(rows, k=self.min_samples, include_self=True, rows_per_side=self.rows_per_side)
        cores = lists.select("row_id", distance_score(F.col("nn")).alias("core"))
        cores = hold(cores)
        eps = self.eps if self.eps is not None else quantiles(cores, "core", [0.9])[0]
        dense = rows.join(cores.filter(F.col("core") <= eps), "row_id", "left_semi")
        member = cluster_roots(dense, eps, self.rows_per_side).join(cores, "row_id")
        groups = member.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("core").alias("least"))
        groups = groups.filter(F.col("size") >= self.min_cluster_size)
        inside = member.join(groups, "root").select(
            "row_id", F.when(F.col("core") > 0, 1.0 - F.col("least") / F.col("core")).otherwise(0.0).alias("score")
        )
        scores = cores.select("row_id").join(inside, "row_id", "left").select(
            "row_id", F.coalesce("score", F.lit(1.0)).alias("score")
        )
        return DensityModel(rows, scores, min(self.min_cluster_size, rows.count()))
