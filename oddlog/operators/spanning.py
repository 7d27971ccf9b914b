"""Minimum spanning trees of points and the tree of their merges.

Edges of few points come from pairs of hash blocks: the spanning trees of all unions of two blocks hold one of all points,
so a pair of blocks returns one edge a point and never its distances. Many points start from a tree of known edges, in the
order of its merges: of two points the largest gap between them in that order is the largest edge on their way in the tree,
and a pair replaces an edge only if it is shorter. Blocks of that order are stored once and read by the pairs of blocks,
which measure all pairs of points and return the few that are shorter.

The edges are cut down by Boruvka rounds (each component keeps its least outgoing edge) until one bounded task can finish.
The merges of the tree are found by halving its edges by weight again and again, so that every task sees a bounded run of
weights over components that are contracted before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from oddlog.operators import nearest as nn
from oddlog.operators.components import components
from oddlog.operators.order import with_position
from oddlog.session import broadcast_if_small, freeze

# Most rows of a block, of the edges or links one task may finish, and of a run of merges.
BLOCK_ROWS = 2048
TASK_EDGES = 1 << 20
# Blocks on a side whose pairs share a cut of their edges.
SHARED = 8
# Pairs of two tiles of points that are measured one by one; a tree of both tiles costs less than more of them.
SINGLY = 1 << 18


def _gaps(x: np.ndarray) -> np.ndarray:
    """All distances of a block by a matrix product; short ones, where it loses digits, are measured exactly."""
    y = x - x.mean(axis=0) if len(x) else x
    xx = np.einsum("ij,ij->i", y, y)
    out = y @ y.T
    out *= -2.0
    out += xx[:, None]
    out += xx
    step = max(1, nn.HELD // max(len(x), 1))
    for at in range(0, len(x), step):
        part = out[at : at + step]
        a, b = np.nonzero(part <= 1e-4 * (xx[at : at + step, None] + xx))
        np.sqrt(np.maximum(part, 0.0, out=part), out=part)
        part[a, b] = nn.exact_gaps(x, x, at + a, b)
    return out


def _prim(x: np.ndarray, core: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning tree of one block under the largest of both core distances and the distance over ``alpha``.

    Weights are exact differences; reaches that differ by less than about 1e-10 of their size may be taken for each other.
    """
    n = len(x)
    gaps = _gaps(x)
    gaps /= alpha
    best, source, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    a, b = np.zeros(max(n - 1, 0), int), np.zeros(max(n - 1, 0), int)
    at = 0
    for step in range(n - 1):
        left[at], best[at] = False, np.inf
        reach = np.maximum(np.maximum(gaps[at], core), core[at])
        closer = left & (reach < best)
        best[closer], source[closer] = reach[closer], at
        at = int(np.argmin(best))
        a[step], b[step] = source[at], at
    return a, b, np.maximum(np.maximum(nn.exact_gaps(x, x, a, b) / alpha, core[a]), core[b])


def reach_edges(points: DataFrame, width: int, alpha: float = 1.0, block_rows: int | None = None, known: DataFrame | None = None,
                bound: int = TASK_EDGES) -> DataFrame:
    """Edges ``(a, b, w)`` that hold a spanning tree of ``points`` (pid, vi, vv, core) by mutual reachability.

    All n * n distances are measured. ``known``: some edges, such as those of neighbour lists, by which points numbered from
    0 that exceed a cell of the grid are put in order; up to ``bound`` of them, as one task orders them.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    n, side = points.count(), block_rows or min(BLOCK_ROWS, nn.side_rows(width))
    blocks = nn.cut(n, side, cores)
    if known is not None and n > SHARED * side:
        return _shorter_edges(points, n, width, alpha, side, known, bound)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pid = pdf.pid.to_numpy()
        a, b, w = _prim(nn.to_matrix(pdf.vi, pdf.vv, width), pdf.core.to_numpy("float64"), alpha)
        return pd.DataFrame({"a": np.minimum(pid[a], pid[b]), "b": np.maximum(pid[a], pid[b]), "w": w})

    dealt = points.withColumn("block", F.pmod(F.xxhash64("pid", F.lit("block")), F.lit(blocks)))
    if blocks == 1:
        met = dealt.select(F.col("block").alias("low"), F.col("block").alias("high"), "pid", "vi", "vv", "core")
    else:
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        met = dealt.withColumn("other", other).filter("block <> other").select(
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "pid", "vi", "vv", "core"
        )
    trees = met.groupBy("low", "high").applyInPandas(
        lambda key, pdf: tree(pdf).assign(low=key[0] // SHARED, high=key[1] // SHARED), "a long, b long, w double, low long, high long"
    )
    if blocks <= SHARED:
        return trees.select("a", "b", "w")
    cut = trees.groupBy("low", "high").applyInPandas(lambda key, pdf: _kruskal(pdf.assign(x=pdf.a, y=pdf.b)), EDGES)
    return cut.distinct()


EDGES = "a long, b long, w double"


def known_edges(lists: DataFrame, points: DataFrame, alpha: float = 1.0, rows: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b, w)`` of neighbour lists (row_id, nn) between points (pid, core) that go by the rows ``qid``.

    An id that stands for several vectors among ``rows`` (id, h) names no point.
    """
    if rows is not None:
        several = rows.groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high")
        points = points.join(several.select(F.col("id").alias("qid")), "qid", "left_anti")
    name = lambda end, row: points.select(F.col("qid").alias(row), F.col("pid").alias(end), F.col("core").alias(f"core_{end}"))
    pairs = lists.select("row_id", F.explode("nn").alias("e")).select("row_id", F.col("e.id").alias("id"), F.col("e.dist").alias("dist"))
    met = pairs.filter("row_id <> id").join(name("x", "row_id"), "row_id").join(name("y", "id"), "id").filter("x <> y")
    w = F.greatest(F.col("dist") / F.lit(alpha), "core_x", "core_y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), w.alias("w")).distinct()


def _in_order(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points 0 to n - 1 in an order whose gaps are the merges of a forest, the gap after each, and the number of its tree.

    The largest gap between two points is the largest edge on their way; trees are parted by infinite gaps.
    """
    find, up = _union_find(n)
    last, first, follows, gap = list(range(n)), list(range(n)), [-1] * n, np.full(n, np.inf)
    order = np.lexsort((b, a, w))
    for x, y, least in zip(a[order].tolist(), b[order].tolist(), w[order].tolist()):
        x, y = find(x), find(y)
        if x == y:
            continue
        follows[last[x]], gap[last[x]] = first[y], least
        up[x], first[y] = y, first[x]
    pid, tree = np.zeros(n, "int64"), np.zeros(n, "int64")
    at = 0
    for number, root in enumerate(i for i in range(n) if up[i] == i):
        point = first[root]
        while point >= 0:
            pid[at], tree[at] = point, number
            at, point = at + 1, follows[point]
    return pid, gap[pid], tree


def _ordered(edges: DataFrame, n: int) -> DataFrame:
    """``(pid, pos, gap, tree)`` of `_in_order`, by one task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]))
        pid, gap, tree = _in_order(*(held[c].to_numpy() for c in "abw"), n)
        yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(np.arange(n)), pa.array(gap), pa.array(tree)], ["pid", "pos", "gap", "tree"])

    return freeze(edges.select("a", "b", "w").coalesce(1).mapInArrow(of, "pid long, pos long, gap double, tree long"))


def _joined(points: DataFrame, known: DataFrame, n: int, width: int, alpha: float, rows: int, bound: int) -> tuple[DataFrame, DataFrame]:
    """A spanning tree of ``points`` that holds the least forest of ``known``, and the order of its points.

    Points drawn from all trees of the forest are joined by trees of theirs, ``rows`` at a time, until one is left.
    """
    tree = spanning_tree(known, bound)
    while True:
        order = _ordered(tree, n)
        trees = order.agg(F.max("tree")).first()[0] + 1
        if trees == 1:
            return tree, order
        each = max(1, rows // trees)
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("pid"), "pid"))
        drawn = order.withColumn("_n", rank).filter(F.col("_n") <= each).select("pid", "tree")
        parts = -(-trees * each // rows)
        # Trees that follow one another are dealt together; of a single part all trees meet.
        drawn = drawn.withColumn("part", F.floor(F.col("tree") * parts / trees))

        def tree_of(pdf: pd.DataFrame) -> pd.DataFrame:
            pid = pdf.pid.to_numpy()
            a, b, w = _prim(nn.to_matrix(pdf.vi, pdf.vv, width), pdf.core.to_numpy("float64"), alpha)
            return pd.DataFrame({"a": np.minimum(pid[a], pid[b]), "b": np.maximum(pid[a], pid[b]), "w": w})

        more = points.join(drawn, "pid").groupBy("part").applyInPandas(tree_of, EDGES)
        tree = spanning_tree(tree.unionByName(more), bound)


def _shorter_edges(points: DataFrame, n: int, width: int, alpha: float, tile: int, known: DataFrame, bound: int) -> DataFrame:
    """Edges of a tree and all pairs of points that are shorter than the largest edge on their way in it."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    if n <= bound:
        tree, order = _joined(points, freeze(known), n, width, alpha, max(2, tile), bound)
    else:
        tree, order = known, with_position(points.select("pid"), ["pid"])[0].withColumn("gap", F.lit(float("inf")))
    blocks = nn.cut(n, min(nn.SIDE_ROWS, SHARED * 2 * tile, max(128, nn.BLOCK_BYTES // (8 * max(width, 1)))), cores)
    rows = -(-n // blocks)
    order = order.select("pid", "pos", "gap", F.floor(F.col("pos") / rows).cast("int").alias("block"))
    highest = {r.block: r.most for r in order.groupBy("block").agg(F.max("gap").alias("most")).collect()}
    packed = nn.stored(points.select("pid", "vi", "vv", "core").join(order, "pid"), blocks)
    found = nn.meetings(packed, packed.select("block", "data"), lambda a, mine, b, theirs: _shorter(a, mine, b, theirs, highest, width, alpha, tile), EDGES, halves=True)
    return tree.select("a", "b", "w").unionByName(found)


def _shorter(a: int, mine: pa.Table, b: int, theirs: pa.Table, highest: dict[int, float], width: int, alpha: float, tile: int) -> pa.Table:
    """Edges of `_shorter_edges` between two blocks, or inside of one."""
    sides = [mine.sort_by("pos")] if a == b else [mine.sort_by("pos"), theirs.sort_by("pos")]
    pid, core, gap = (np.concatenate([t[c].to_numpy() for t in sides]) for c in ("pid", "core", "gap"))
    x = np.concatenate([nn.arrow_matrix(t["vi"], t["vv"], width) for t in sides])
    half = len(mine)
    if a != b:
        gap[half - 1] = max([gap[half - 1], *(highest[c] for c in range(a + 1, b))])
    x -= x.mean(axis=0)
    ends = [*range(0, half, tile)], [*range(0 if a == b else half, len(x), tile)]
    stop = lambda at: min(at + tile, half if at < half else len(x))
    out, held = [], 0
    for s in ends[0]:
        for t in ends[1]:
            if t < s:
                continue
            edges = _shorter_in(x, core, gap, s, stop(s), t, stop(t), alpha)
            out.append(edges)
            held += len(edges[0])
            if held > TASK_EDGES:
                out = [_needed(gap, *(np.concatenate(c) for c in zip(*out)))]
                held = len(out[0][0])
    i, j, w = _needed(gap, *(np.concatenate(c) for c in zip(*out)))
    return pa.table({"a": np.minimum(pid[i], pid[j]), "b": np.maximum(pid[i], pid[j]), "w": w})


def _shorter_in(x: np.ndarray, core: np.ndarray, gap: np.ndarray, s: int, s_end: int, t: int, t_end: int, alpha: float):
    """Pairs (i, j, w) of the tiles from s and from t, or of one, whose reach is below the largest gap between them."""
    here = s == t
    if here:
        later = np.arange(s, s_end)[None, :] > np.arange(s, s_end)[:, None]
        most = np.maximum.accumulate(np.where(later, np.append(-np.inf, gap[s : s_end - 1])[None, :], -np.inf), axis=1)
    else:
        low = np.maximum.accumulate(gap[s:t][::-1])[::-1][: s_end - s]
        high = np.append(-np.inf, np.maximum.accumulate(gap[t : t_end - 1])) if t_end > t else np.zeros(0)
    u, v = x[s:s_end], x[t:t_end]
    scale = sum(float(np.einsum("ij,ij->i", y, y).max(initial=0.0)) for y in (u, v))
    for kind, slack in nn.kinds(scale, x.shape[1]):
        gaps = nn.factors(u, kind, True) @ nn.factors(v, kind, False).T
        limit = lambda g: ((alpha * np.maximum(g, 0.0)) ** 2 * (1 + 1e-6) + slack).astype(kind)
        near = (gaps < limit(most)) & later if here else (gaps < limit(low)[:, None]) | (gaps < limit(high))
        if np.count_nonzero(near) <= near.size >> 4:
            break
    if np.count_nonzero(near) > SINGLY:
        at = np.arange(s, s_end) if here else np.append(np.arange(s, s_end), np.arange(t, t_end))
        i, j, w = _prim(x[at], core[at], alpha)
        i, j = np.minimum(at[i], at[j]), np.maximum(at[i], at[j])
        return i, j, w
    i, j = np.divmod(nn.places(near), len(v))
    w = np.maximum(np.maximum(nn.exact_gaps(u, v, i, j) / alpha, core[s + i]), core[t + j])
    kept = w < (most[i, j] if here else np.maximum(low[i], high[j]))
    return s + i[kept], t + j[kept], w[kept]


def _needed(gap: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges between points in order those that no edges as short, or gaps as small, make up for."""
    if not len(i):
        return i, j, w
    finite = np.flatnonzero(np.isfinite(gap[:-1]))
    start = np.append(finite, i)
    order = np.argsort(np.append(gap[finite], w), kind="stable")
    find, up = _union_find(len(gap))
    kept = np.zeros(len(start), bool)
    for e, p, q in zip(order.tolist(), start[order].tolist(), np.append(finite + 1, j)[order].tolist()):
        p, q = find(p), find(q)
        if p != q:
            up[p], kept[e] = q, True
    kept = kept[len(finite) :]
    return i[kept], j[kept], w[kept]


def _union_find(n: int):
    """``find`` and its parent list."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    return find, up


def _kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["w", "a", "b"], ignore_index=True)
    names, code = np.unique(np.concatenate([pdf.x.to_numpy(), pdf.y.to_numpy()]), return_inverse=True)
    find, up = _union_find(len(names))
    kept = np.zeros(len(pdf), bool)
    for i, (x, y) in enumerate(zip(code[: len(pdf)].tolist(), code[len(pdf) :].tolist())):
        x, y = find(x), find(y)
        if x != y:
            up[x], kept[i] = y, True
    return pdf.loc[kept, ["a", "b", "w"]]


def spanning_tree(edges: DataFrame, bound: int = TASK_EDGES) -> DataFrame:
    """The edges ``(a, b, w)`` of a least spanning forest; of equal weights the pair of lower ids goes first.

    A round at least halves the components. At most ``bound`` edges are left to one task.
    """
    order = F.struct("w", "a", "b", "x", "y")
    live = freeze(edges.select("w", "a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).filter("x <> y"))
    kept = []
    while (left := live.count()) > bound:
        ends = live.select(F.col("x").alias("node"), order.alias("e")).unionByName(live.select(F.col("y").alias("node"), order.alias("e")))
        picks = freeze(ends.groupBy("node").agg(F.min("e").alias("e")).select("e.*").distinct())
        kept.append(picks.select("a", "b", "w"))
        roots = freeze(components(picks.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        size = roots.count()
        side = lambda name: broadcast_if_small(roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root")), size)
        outer = live.join(side("x"), "x").join(side("y"), "y").filter("x_root <> y_root").select(
            "w", "a", "b", F.least("x_root", "y_root").alias("x"), F.greatest("x_root", "y_root").alias("y")
        )
        live = freeze(outer.groupBy("x", "y").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*", "x", "y"))
    if left:
        kept.append(live.groupBy(F.lit(0).alias("all")).applyInPandas(
            lambda pdf: _kruskal(pdf), "a long, b long, w double"
        ))
    out = kept[0] if kept else live.select("a", "b", "w")
    for more in kept[1:]:
        out = out.unionByName(more)
    return freeze(out)


def _run_of_merges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges of one run of edges over contracted components (a, b of sizes sa, sb, last merged as ta, tb)."""
    pdf = pdf.sort_values("node", ignore_index=True)
    n = len(pdf)
    names, first, code = np.unique(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]), return_index=True, return_inverse=True)
    size = np.concatenate([pdf.sa.to_numpy(), pdf.sb.to_numpy()])[first].tolist()
    top = np.concatenate([pdf.ta.to_numpy(), pdf.tb.to_numpy()])[first].tolist()
    find, up = _union_find(len(names))
    out = np.zeros((n, 3), "int64")
    for i, (x, y, node) in enumerate(zip(code[:n].tolist(), code[n:].tolist(), pdf.node.tolist())):
        x, y = find(x), find(y)
        out[i] = size[x] + size[y], top[x], top[y]
        up[x] = y
        size[y] += size[x]
        top[y] = node
    return pd.DataFrame({"node": pdf.node, "w": pdf.w, "size": out[:, 0], "left": out[:, 1], "right": out[:, 2]})


MERGES = "node long, w double, size long, left long, right long"


def merge_tree(tree: DataFrame, points: DataFrame, n_points: int, run: int = TASK_EDGES) -> DataFrame:
    """``(node, w, size, left, right)``: one merge an edge, in order of weight, of the components below it.

    ``points``: pid from 0 to n_points - 1 and the rows each stands for (size). A merge has the number n_points + its
    place in the order; ``left`` and ``right`` are points or earlier merges.
    """
    ranked, n = with_position(tree, ["w", "a", "b"])
    edges = ranked.select((F.col("pos") + n_points).alias("node"), F.floor(F.col("pos") / run).alias("run"), "w", "a", "b")
    for end in "ab":
        sizes = points.select(F.col("pid").alias(end), F.col("size").alias(f"s{end}"))
        edges = edges.join(broadcast_if_small(sizes, n_points), end).withColumn(f"t{end}", F.col(end))
    edges = freeze(edges)
    span = 1
    while span * run < n:
        span *= 2
    while span > 1:
        edges = edges.withColumn("part", F.floor(F.col("run") / span))
        low = F.pmod("run", F.lit(span)) < span // 2
        light, heavy = edges.filter(low), edges.filter(~low)
        at = lambda end: F.struct("part", F.col(end).alias("v"))
        roots = freeze(components(light.select(at("a").alias("a"), at("b").alias("b"))))
        ends = light.select(at("a").alias("node"), F.col("sa").alias("size")).unionByName(light.select(at("b").alias("node"), F.col("sb").alias("size")))
        sizes = ends.distinct().join(roots, "node").groupBy("root").agg(F.sum("size").alias("size"))
        tops = light.select(at("a").alias("node"), F.col("node").alias("top")).join(roots, "node").groupBy("root").agg(F.max("top").alias("top"))
        whole = freeze(roots.join(sizes.join(tops, "root"), "root").select("node.part", "node.v", F.col("root.v").alias("root"), "size", "top"))
        for end in "ab":
            below = whole.select("part", F.col("v").alias(end), "root", "size", "top")
            heavy = heavy.join(below, ["part", end], "left").withColumns({
                end: F.coalesce("root", end), f"s{end}": F.coalesce("size", f"s{end}"), f"t{end}": F.coalesce("top", f"t{end}"),
            }).drop("root", "size", "top")
        edges = freeze(light.unionByName(heavy).drop("part"))
        span //= 2
    return freeze(edges.groupBy("run").applyInPandas(_run_of_merges, MERGES))


def _climbed(pdf: pd.DataFrame) -> pd.DataFrame:
    node, up = pdf.node.to_numpy(), pdf.up.to_numpy()
    order = np.argsort(node)
    while True:
        at = np.minimum(np.searchsorted(node, up, sorter=order), len(node) - 1)
        more = node[order[at]] == up
        if not more.any():
            return pd.DataFrame({"node": node, "top": up})
        up = np.where(more, up[order[at]], up)


def climb(links: DataFrame, bound: int = TASK_EDGES) -> DataFrame:
    """``(node, top)``: where the links ``(node, up)`` of a forest lead at last, for every node that has one.

    Links are doubled round by round, as deep as the logarithm of the longest way; at most ``bound`` go to one task.
    """
    links = freeze(links.select("node", "up"))
    if links.count() <= bound:
        return freeze(links.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: _climbed(pdf), "node long, top long"))
    while True:
        above = links.select(F.col("node").alias("up"), F.col("up").alias("further"))
        moved = freeze(links.join(above, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("more")))
        links = moved.select("node", "up")
        if not moved.filter("more").limit(1).count():
            return links.withColumnRenamed("up", "top")
