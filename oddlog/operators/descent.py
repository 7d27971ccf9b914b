"""Neighbour lists without all pairs: neighbours of neighbours are tried until lists stop changing (Dong et al. 2011).

Lists start from a few random projections: rows that follow each other along one meet in a leaf of bounded size. In a
round every row gathers those that have it in their list and those in its own (bounded, the rest by hash another time)
and all of them are measured against each other, unless both were there before; what beats a row's last neighbour joins
its list. A round moves a row's vector once for each list it is in, so rows into the shuffle stay a constant times the
table, whatever its size. Each round is written before the next. The recall of the result is measured against exact
lists of a hash sample of rows and returned with it.

Bounded lists lose neighbours where distances hardly differ (many features without structure), the more the larger the
table. A caller who names the recall it needs gets exact lists (`nearest`) when the rounds do not reach it, and as soon
as their gains show that they will not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from oddlog.operators.nearest import _distinct, nearest, to_matrix, unpacked, vector_width
from oddlog.session import broadcast_if_small, freeze

PROJECTIONS, LEAF = 4, 128
ROUNDS, STILL = 10, 0.002  # at most so many rounds, or until a smaller share of entries is new
CHECKED = 400  # rows whose lists are compared with exact ones
WIDEST = 4096  # features of a dense row


@dataclass(frozen=True)
class Descent:
    lists: DataFrame  # (row_id, nn) as of `nearest`
    recall: float
    rounds: int
    measured: int  # distances in all


def _projected(vectors: DataFrame, width: int, seed: int) -> DataFrame:
    """(h, vi, vv, at): the place of each row along PROJECTIONS random directions."""
    axes = np.random.default_rng(seed).normal(size=(width, PROJECTIONS))

    def place(batches):
        for pdf in batches:
            values = to_matrix(pdf.vi, pdf.vv, width) @ axes
            yield pdf.assign(at=pd.Series(list(values), dtype=object))

    return vectors.select("h", "vi", "vv").mapInPandas(place, "h long, vi array<int>, vv array<double>, at array<double>")


def _pairs(ids: np.ndarray, x: np.ndarray, fresh: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(for, neighbour, distance) of pairs that beat the last neighbour of `for`, and how many were measured."""
    a, b = np.triu_indices(len(ids), 1)
    new = (fresh[a] | fresh[b]) & (ids[a] != ids[b])
    a, b = a[new], b[new]
    measured = len(a)
    # A matrix product finds the candidates, an exact difference measures them.
    xx = np.einsum("ij,ij->i", x, x)
    reach = np.maximum(far[a], far[b])
    near = xx[a] + xx[b] - 2.0 * (x @ x.T)[a, b] <= reach * reach + 1e-9 * (xx[a] + xx[b]) + 1e-12
    a, b = a[near], b[near]
    gap = x[a] - x[b]
    dist = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    left, right = dist < far[a], dist < far[b]
    return np.concatenate([ids[a[left]], ids[b[right]]]), np.concatenate([ids[b[left]], ids[a[right]]]), np.concatenate([dist[left], dist[right]]), measured


FOUND = "h long, other long, dist double, measured long"


def _meet(members: DataFrame, group: str, bins: int, width: int) -> DataFrame:
    """Pairs inside each `group` of rows (h, vi, vv, fresh, far); a bin holds whole groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf[group].to_numpy(), kind="stable")
        pdf = pdf.iloc[order]
        of, ids = pdf[group].to_numpy(), pdf.h.to_numpy("int64")
        x = to_matrix(pdf.vi, pdf.vv, width)
        fresh, far = pdf.fresh.to_numpy(bool), pdf.far.to_numpy("float64")
        cuts = np.flatnonzero(np.diff(of, prepend=of[:1] - 1)) if len(of) else []
        out, measured = [], 0
        for low, high in zip(cuts, [*cuts[1:], len(of)]):
            h, other, dist, n = _pairs(ids[low:high], x[low:high], fresh[low:high], far[low:high])
            out.append((h, other, dist))
            measured += n
        h, other, dist = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
        # Several groups of a bin find the same pair.
        found = pd.DataFrame({"h": h, "other": other, "dist": dist}).drop_duplicates(["h", "other"]).assign(measured=0)
        return pd.concat([found, pd.DataFrame({"h": [0], "other": [0], "dist": [-1.0], "measured": [measured]})])

    return members.withColumn("_bin", F.pmod(F.xxhash64(group), F.lit(bins))).groupBy("_bin").applyInPandas(run, FOUND)


def _merged(lists: DataFrame | None, found: DataFrame, size: int) -> DataFrame:
    """(h, nn) with the `size` nearest of what a row had and what it found."""
    new = found.filter("dist >= 0").select("h", "other", "dist", F.lit(True).alias("fresh"))
    if lists is not None:
        held = lists.select("h", F.explode("nn").alias("e")).select("h", F.col("e.h").alias("other"), F.col("e.dist").alias("dist"), F.lit(False).alias("fresh"))
        new = held.unionByName(new)
    once = new.groupBy("h", "other").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("h").orderBy("dist", "other"))
    kept = once.withColumn("_n", rank).filter(F.col("_n") <= size)
    return kept.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("dist", F.col("other").alias("h"), "fresh"))).alias("nn"))


def _round(lists: DataFrame, vectors: DataFrame, size: int, bins: int, width: int, turn: int) -> DataFrame:
    edges = lists.select("h", F.explode("nn").alias("e")).select("h", F.col("e.h").alias("other"), F.col("e.fresh").alias("fresh"))
    mine = edges.select(F.col("h").alias("centre"), F.col("other").alias("h"), "fresh")
    back = edges.select(F.col("other").alias("centre"), "h", "fresh")
    # A row many lists hold meets `size` of them a round, new ones first and others in other rounds.
    turns = F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("h", F.lit(turn))))
    back = back.withColumn("_n", turns).filter(F.col("_n") <= size).drop("_n")
    members = mine.unionByName(back).groupBy("centre", "h").agg(F.max("fresh").alias("fresh"))
    # Where nothing is new, all have met before.
    members = members.withColumn("_any", F.max("fresh").over(Window.partitionBy("centre"))).filter("_any").drop("_any")
    last = lists.select("h", F.when(F.size("nn") >= size, F.element_at("nn", -1)["dist"]).otherwise(float("inf")).alias("far"))
    return _meet(members.join(vectors.select("h", "vi", "vv").join(last, "h"), "h"), "centre", bins, width)


def _hopeless(recalls: list[float], least: float) -> bool:
    """Whether gains that have begun to fall leave the recall below ``least`` after all rounds."""
    if len(recalls) < 3 or recalls[-1] >= least:
        return False
    before, gain = recalls[-2] - recalls[-3], recalls[-1] - recalls[-2]
    return gain <= before and recalls[-1] + gain * (ROUNDS - len(recalls)) < least


def descend(rows: DataFrame, k: int = 5, extra: int = 15, key: str = "row_id", features: str = "features", seed: int = 7, least: float = 0.0) -> Descent:
    """The k nearest other rows of each row, as `nearest` gives them but for what the search misses.

    Copies of a vector are merged for the search. Lists hold k + extra rows while it runs. With ``least`` the lists are
    exact where the search does not reach that recall.
    """
    width = vector_width(rows, features)
    if width > WIDEST:
        raise ValueError(f"{width} features are too many for lists by descent; encode them first")
    asked = unpacked(rows, key, features, width)
    both = asked.withColumn("is_query", F.lit(True)).withColumn("is_base", F.lit(True))
    vectors = freeze(_distinct(both, k + 1, True).select("h", "vi", "vv", "ids"))
    n, size = vectors.count(), k + extra
    spark = rows.sparkSession
    # A bin's rows fill about 16 MB as doubles.
    bins = max(spark.sparkContext.defaultParallelism, n * size * 2 * max(width, 1) * 8 >> 24)
    placed = freeze(_projected(vectors, width, seed))
    cuts = max(1, n // LEAF)
    shares = [c / cuts for c in range(1, cuts)]
    bounds = placed.select(*[F.percentile_approx(F.get("at", F.lit(p)), shares or [0.5], 100_000).alias(f"p{p}") for p in range(PROJECTIONS)])
    leaves = placed.crossJoin(F.broadcast(bounds)) if shares else None  # one row of bounds
    spot = lambda p: F.size(F.filter(f"p{p}", lambda b: b < F.get("at", F.lit(p)))) if shares else F.lit(0)
    spread = (leaves if shares else placed).select("h", "vi", "vv", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), spot(p).alias("leaf")) for p in range(PROJECTIONS)])).alias("l"))
    # Rows that share a place beyond a leaf's size are cut by hash.
    crowd = spread.groupBy("l").agg(F.ceil(F.count(F.lit(1)) / (4 * LEAF)).alias("share"))
    crowd = crowd.filter("share > 1").select(F.col("l").alias("_l"), "share")
    full = spread.join(F.broadcast(crowd) if cuts < 100_000 else crowd, F.col("l") == F.col("_l"), "left")
    leaf = F.xxhash64("l.p", "l.leaf", F.pmod(F.xxhash64("h"), F.coalesce("share", F.lit(1))))
    started = freeze(_meet(full.select("h", "vi", "vv", leaf.alias("leaf"), F.lit(True).alias("fresh"), F.lit(float("inf")).alias("far")), "leaf", bins, width))
    measured = started.agg(F.sum("measured")).first()[0] or 0
    lists = freeze(_merged(None, started, size))
    some, want = _exact_sample(rows, k, key, features)
    part = freeze(asked.join(F.broadcast(some.select(F.col("row_id").alias("id"))), "id", "left_semi"))
    part_of = F.broadcast(part.select(F.xxhash64("vi", "vv").alias("h")).distinct())
    turn, recalls = 0, []
    while turn < ROUNDS and n > 1:
        turn += 1
        found = freeze(_round(lists, vectors, size, bins, width, turn))
        measured += found.agg(F.sum("measured")).first()[0] or 0
        lists = freeze(_merged(lists, found, size))
        fresh = lists.agg(F.sum(F.size(F.filter("nn", lambda e: e["fresh"])))).first()[0] or 0
        if fresh <= STILL * n * size:
            break
        if least:
            recalls.append(_recall(_by_row(lists.join(part_of, "h", "left_semi"), vectors, part, k), want))
            if _hopeless(recalls, least):
                return _exact(rows, k, key, features, turn, measured, n)
    out = _by_row(lists, vectors, asked, k)
    recall = _recall(out.join(F.broadcast(some.select("row_id")), "row_id"), want)
    return Descent(out, recall, turn, measured) if recall >= least else _exact(rows, k, key, features, turn, measured, n)


def _exact(rows: DataFrame, k: int, key: str, features: str, turns: int, measured: int, n: int) -> Descent:
    return Descent(freeze(nearest(rows, k=k, key=key, features=features)), 1.0, turns, measured + n * n)


def _by_row(lists: DataFrame, vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Lists of row ids: copies first, then the ids of each neighbouring vector."""
    entries = lists.select("h", F.explode("nn").alias("e")).select("h", F.col("e.h").alias("other"), F.col("e.dist").alias("dist"))
    near = entries.join(vectors.select(F.col("h").alias("other"), "ids"), "other").select("h", "dist", F.explode("ids").alias("id"))
    rank = F.row_number().over(Window.partitionBy("h").orderBy("dist", "id"))
    best = near.withColumn("_n", rank).filter(F.col("_n") <= k).groupBy("h").agg(F.collect_list(F.struct("dist", "id")).alias("far"))
    empty = F.array().cast("array<struct<dist:double,id:long>>")
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("id")))
    known = vectors.join(best, "h", "left").select("h", F.slice(F.array_sort(F.concat(own, F.coalesce("far", empty))), 1, k + 1).alias("nn"))
    mine = asked.select(F.col("id").alias("row_id"), F.xxhash64("vi", "vv").alias("h"))
    others = F.filter("nn", lambda e: e["id"] != F.col("row_id"))
    return freeze(mine.join(known, "h").select("row_id", F.slice(others, 1, k).alias("nn")))


def _exact_sample(rows: DataFrame, k: int, key: str, features: str) -> tuple[DataFrame, DataFrame]:
    """CHECKED rows (those of least hash) and ``(row_id, want)``, the distances of their exact neighbours."""
    every = rows.select(F.col(key).alias("row_id"), F.col(features).alias("features"))
    some = freeze(every.orderBy(F.xxhash64("row_id"), "row_id").limit(CHECKED))
    others = F.slice(F.filter("nn", lambda e: e["id"] != F.col("row_id")), 1, k)
    return some, freeze(nearest(some, every, k + 1).select("row_id", F.transform(others, lambda e: e["dist"]).alias("want")))


def _recall(lists: DataFrame, want: DataFrame) -> float:
    """Share of the exact neighbours of the checked rows that their lists hold, by distance."""
    met = want.join(broadcast_if_small(lists, CHECKED), "row_id")
    last = F.coalesce(F.try_element_at("want", F.lit(-1)), F.lit(0.0))
    good = F.size(F.filter("nn", lambda e: e["dist"] <= last + 1e-12))
    found = met.agg(F.sum(F.least(good, F.size("want"))), F.sum(F.size("want"))).first()
    return 1.0 if not found[1] else found[0] / found[1]
