"""k nearest neighbours over many tasks.

Copies of a vector are merged first, keeping the k + 1 smallest row ids. Then queries are dealt into q groups and base
rows into p, by hash, and each of the p x q cells of the grid is one task: a query crosses the network p times, a base
row q times. Cells are as many as keep the cores busy, and more once a side would pass SIDE_BYTES. Partial top-k lists
are merged per query, so no pair of rows leaves a task unless it is in a list.

This meets every pair; `descent` finds most of the same lists without.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from oddlog.operators.boxes import Boxes, reached
from oddlog.session import freeze

DENSE_WIDTH = 256
SIDE_BYTES = 64 << 20
SIDE_ROWS = 1 << 15
# Most bytes of the dense matrix of a stored block: a task gets two blocks as one row.
BLOCK_BYTES = 16 << 20
# Distances, or entries of differences, that a task holds at a time.
HELD = 1 << 20
# Most features for which boxes are searched, and the base rows and queries of a box that meet in a task.
FEW_WIDTH = 4
BOX_ROWS, BOX_ASKS = 1 << 12, 1 << 14
# Points drawn to find the walls, at least as many to a box, and boxes to a query from which on all pairs meet.
DRAWN, DRAWN_BOX, MOST_BOXES = 1 << 16, 32, 16
# Columns of a tile of distances.
TILE = 2048


def side_rows(width: int) -> int:
    """Rows on a side of a cell, by the bytes of their dense matrix."""
    return int(min(SIDE_ROWS, max(128, SIDE_BYTES // (8 * max(width, 1)))))


def cut(rows: int, side: int, cores: int) -> int:
    """Groups of one side of the grid."""
    return max(1, min(rows, max(-(-rows // side), math.ceil(math.sqrt(2 * cores)))))


def vector_width(df: DataFrame, features: str = "features") -> int:
    row = df.select(features).first()
    return 0 if row is None else int(row[0].size)


def unpacked(df: DataFrame, key: str, features: str, width: int) -> DataFrame:
    """``(id, vi, vv)``: values, with positions when the vectors are wide."""
    if width <= DENSE_WIDTH:
        return df.select(F.col(key).alias("id"), F.lit(None).cast("array<int>").alias("vi"),
                         vector_to_array(features).alias("vv"))
    u = F.unwrap_udt(F.col(features))
    kept = F.when(
        u["type"] == 0, F.arrays_zip(u["indices"].alias("i"), u["values"].alias("x"))
    ).otherwise(F.transform(u["values"], lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    kept = F.filter(kept, lambda e: e["x"] != 0)
    return df.select(F.col(key).alias("id"), kept.alias("e")).select(
        "id", F.col("e.i").alias("vi"), F.col("e.x").alias("vv")
    )


def to_matrix(vi: pd.Series, vv: pd.Series, width: int) -> np.ndarray:
    """Dense matrix of one block."""
    if len(vv) == 0:
        return np.zeros((0, width))
    if width <= DENSE_WIDTH:
        return np.stack(vv.to_numpy()).astype("float64", copy=False)
    out = np.zeros((len(vv), width))
    sizes = vv.map(len).to_numpy()
    if sizes.sum():
        rows = np.repeat(np.arange(len(vv)), sizes)
        out[rows, np.concatenate(list(vi)).astype("int64")] = np.concatenate(list(vv))
    return out


def arrow_matrix(vi: pa.ChunkedArray, vv: pa.ChunkedArray, width: int) -> np.ndarray:
    """As `to_matrix`, from Arrow columns and without an object per row."""
    sizes = pc.list_value_length(vv).to_numpy()
    values = pc.list_flatten(vv).to_numpy()
    if width <= DENSE_WIDTH:
        if (sizes != width).any():
            raise ValueError("vectors of one table have one width")
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(vi).to_numpy()] = values
    return out


def factors(x: np.ndarray, kind: type, left: bool) -> np.ndarray:
    """Factors whose product holds all squared distances, as (-2 x, xx, 1) and (x, 1, xx)."""
    xx, one = np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1))
    return np.hstack([-2.0 * x, xx, one] if left else [x, one, xx]).astype(kind)


def kinds(scale: float, width: int) -> list[tuple[type, float]]:
    """Number types for a product of `factors` of squares up to ``scale``, cheap ones first, and what their rounding may hide."""
    return [(kind, scale * (width + 16) * float(np.finfo(kind).eps)) for kind in (np.float32, np.float64) if kind is np.float64 or 1e-30 < scale < 1e30]


def places(mask: np.ndarray) -> np.ndarray:
    """`np.flatnonzero` of a mask with few entries, eight at a time."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


def _close_pairs(q: np.ndarray, x: np.ndarray, need: np.ndarray, own: np.ndarray):
    """(row, column, distance) of every pair that may be among ``need`` nearest, some rows at a time.

    A matrix product finds the candidates, in single precision unless that leaves too many; an exact difference measures
    them. ``own[i]`` is the column to leave out for query i, or -1.
    """
    if not len(x) or not len(q):
        return
    middle = x.mean(axis=0)
    at_q, at_x = q - middle, x - middle
    square = lambda y: float(np.einsum("ij,ij->i", y, y).max())
    ways = kinds(square(at_q) + square(at_x), x.shape[1])
    left, right = factors(at_q, ways[0][0], True), factors(at_x, ways[0][0], False)
    # Rows of a strip and columns of a tile; the first tile bounds what the others may add to a list.
    wide = min(len(x), TILE)
    step = max(1, HELD // wide)
    for at in range(0, len(q), step):
        end = min(at + step, len(q))
        most = min(int(need[at:end].max()), len(x))
        if most == 0:
            continue
        silent = need[at:end] <= 0
        bound = np.full(end - at, np.inf)
        found = []
        for col in range(0, len(x), wide):
            mine = np.flatnonzero((own[at:end] >= col) & (own[at:end] < col + wide))
            for kind, slack in ways:
                if kind is ways[0][0]:
                    squares = left[at:end] @ right[col : col + wide].T
                else:
                    squares = factors(at_q[at:end], kind, True) @ factors(at_x[col : col + wide], kind, False).T
                squares[mine, own[at:end][mine] - col] = np.inf
                if col == 0 and squares.shape[1] >= most:
                    bound = np.partition(squares, most - 1, axis=1)[:, most - 1].astype(np.float64) + slack
                bound[silent] = -np.inf
                near = squares <= bound[:, None].astype(kind)
                if np.count_nonzero(near) <= near.size >> 4:
                    break
            near = places(near)
            rows, cols = np.divmod(near, squares.shape[1])
            gaps = squares.ravel()[near].astype(np.float64)
            kept = np.isfinite(gaps)
            found.append((rows[kept], cols[kept] + col, gaps[kept]))
        rows, cols, gaps = (np.concatenate(c) for c in zip(*found))
        if len(found) > 1:
            order = np.lexsort((gaps, rows))
            rows, cols, gaps = rows[order], cols[order], gaps[order]
            first = np.searchsorted(rows, np.arange(end - at))
            full = first + most <= np.append(first[1:], len(rows))
            bound[full] = gaps[first[full] + most - 1] + ways[0][1]
            kept = gaps <= bound[rows]
            rows, cols = rows[kept], cols[kept]
        yield at + rows, cols, exact_gaps(q, x, at + rows, cols)


def exact_gaps(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of the pairs (q[rows], x[cols])."""
    out = np.zeros(len(rows))
    piece = max(1, HELD // max(q.shape[1], 1))
    for p in range(0, len(rows), piece):
        gap = q[rows[p : p + piece]] - x[cols[p : p + piece]]
        out[p : p + piece] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _top(rows, cols, dist, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, need: np.ndarray):
    """(row, distance, id) of the ``need`` closest ids of each row, by distance, then id; column c stands for
    ``sizes[c]`` ids of ``flat``."""
    reps = sizes[cols]
    inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    row, gap = np.repeat(rows, reps), np.repeat(dist, reps)
    member = flat[np.repeat(starts[cols], reps) + inner]
    order = np.lexsort((member, gap, row))
    row, gap, member = row[order], gap[order], member[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < need[row]
    return row[kept], gap[kept], member[kept]


def _lists_in(queries: pa.Table, base: pa.Table, need: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, distance, id) of the lists of ``queries`` (need rows each) among ``base`` (ids), but for a query's own vector."""
    out = [(np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64"))]
    if len(queries) and len(base):
        q, x = (arrow_matrix(t["vi"], t["vv"], width) for t in (queries, base))
        qid = queries["qid"].to_numpy()
        asked = pc.is_valid(base["qid"]).to_numpy()
        at = pd.Series(np.flatnonzero(asked), index=base["qid"].drop_null().to_numpy())
        own = at.reindex(qid).fillna(-1).to_numpy("int64")
        sizes = pc.list_value_length(base["ids"]).to_numpy().astype("int64")
        flat, starts = pc.list_flatten(base["ids"]).to_numpy(), np.cumsum(sizes) - sizes
        for rows, cols, dist in _close_pairs(q, x, need, own):
            out.append(_top(rows, cols, dist, flat, starts, sizes, need))
    return tuple(np.concatenate(c) for c in zip(*out))


def _nearest_in(queries: pa.Table, base: pa.Table, need: np.ndarray, width: int) -> pa.Table:
    """Entries of the neighbour lists of `_lists_in`."""
    rows, gaps, members = _lists_in(queries, base, need, width)
    return pa.table({"qid": pa.array(queries["qid"].to_numpy()[rows], pa.int64()), "dist": pa.array(gaps, pa.float64()), "id": pa.array(members, pa.int64())})


def _distinct(rows: DataFrame, keep: int, self_join: bool) -> DataFrame:
    """One row per vector: base ids (the ``keep`` smallest) and a query id."""
    rows = rows.withColumn("h", F.xxhash64("vi", "vv"))
    same = ["h", "vi", "vv"]
    rank = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    base = rows.filter("is_base").withColumn("_n", rank).filter(F.col("_n") <= keep)
    base = base.groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    if self_join:
        return base.withColumn("qid", F.col("ids")[0])
    asked = rows.filter("is_query").groupBy(*same).agg(F.min("id").alias("qid"))
    both = base.withColumn("qid", F.lit(None).cast("long")).unionByName(
        asked.withColumn("ids", F.lit(None).cast("array<long>"))
    )
    return both.groupBy(*same).agg(
        F.coalesce(F.max("ids"), F.array().cast("array<long>")).alias("ids"), F.max("qid").alias("qid")
    )


ENTRIES = "qid long, dist double, id long"


def stored(rows: DataFrame, blocks: int) -> DataFrame:
    """``(block, data)``: the rows of each block (a column of numbers below ``blocks``) as one value, written once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        for block in pc.unique(table["block"]).to_pylist():
            sink = pa.BufferOutputStream()
            part = table.filter(pc.equal(table["block"], block)).drop_columns(["block"]).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

    dealt = rows.withColumn("block", F.col("block").cast("int"))
    return freeze(dealt.repartitionById(blocks, "block").mapInArrow(pack, "block int, data binary"))


def meetings(left: DataFrame, right: DataFrame, meet: Callable[[int, pa.Table, int, pa.Table], pa.Table], schema: str, halves: bool = False) -> DataFrame:
    """What ``meet`` makes of each pair of `stored` blocks, a task a pair; with ``halves`` only pairs whose left number is no larger.

    Tasks read the stored blocks; no copy of a block is shuffled.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, mine, b, theirs in zip(*(batch.column(i) for i in range(4))):
                tables = (pa.ipc.open_stream(c.as_buffer()).read_all() for c in (mine, theirs))
                yield from meet(a.as_py(), next(tables), b.as_py(), next(tables)).to_batches()

    mine = left.select(F.col("block").alias("a"), F.col("data").alias("mine"))
    theirs = right.select(F.col("block").alias("b"), F.col("data").alias("theirs")).hint("shuffle_replicate_nl")
    pairs = mine.join(theirs, F.col("a") <= F.col("b")) if halves else mine.crossJoin(theirs)
    return pairs.mapInArrow(read, schema)


def _deal(salt: str, n: int):
    return F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(n)).cast("int")


def _blocks(vectors: DataFrame, side: int, cores: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of `grid` as stored blocks."""
    asks = vectors.filter("qid IS NOT NULL")
    bases = vectors.filter(F.size("ids") > 0)
    p, q = cut(bases.count(), side, cores), cut(asks.count(), side, cores)
    left = stored(asks.select(_deal("query", q).alias("block"), "vi", "vv", "qid", F.size("ids").alias("held")), q)
    right = stored(bases.select(_deal("base", p).alias("block"), "vi", "vv", "ids", "qid"), p)
    return left, right


def grid(vectors: DataFrame, side: int, cores: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of all cells: queries and base rows with ``a`` and ``b``.

    ``vectors``: h, vi, vv, ids (as base), qid (as query).
    """
    asks = vectors.filter("qid IS NOT NULL")
    bases = vectors.filter(F.size("ids") > 0)
    p, q = cut(bases.count(), side, cores), cut(asks.count(), side, cores)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select(_deal("query", q).alias("a"), every(p).alias("b"), "vi", "vv", "qid", F.size("ids").alias("held"))
    right = bases.select(every(q).alias("a"), _deal("base", p).alias("b"), "vi", "vv", "ids", "qid")
    return left, right


def _wanted(ask: pa.Table, k: int, skip_self: bool) -> np.ndarray:
    """Rows a query needs; other copies of it are told by their ids, so it needs fewer."""
    return np.clip(k - np.maximum(ask["held"].to_numpy() - skip_self, 0), 0, k)


def _first(entries: DataFrame, k: int) -> DataFrame:
    """``(qid, far)``: the k first entries (dist, id) of each query."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("e.dist", "e.id"))
    return entries.withColumn("_n", rank).filter(F.col("_n") <= k).groupBy("qid").agg(F.collect_list("e").alias("far"))


def _by_boxes(vectors: DataFrame, k: int, width: int, skip_self: bool, box_rows: int) -> DataFrame | None:
    """``(qid, far)`` by way of boxes; none if the lists reach so many boxes that all pairs may as well meet."""
    asks, bases = vectors.filter("qid IS NOT NULL"), vectors.filter(F.size("ids") > 0)
    n_asks, n_bases = asks.count(), bases.count()
    draw = F.pmod(F.xxhash64("h", F.lit("box")), F.lit(max(1, n_bases // DRAWN))) == 0
    drawn = np.array([r.vv for r in bases.filter(draw).select("vv").collect()]).reshape(-1, width)
    boxes = Boxes(drawn, min(-(-n_bases // box_rows), max(1, len(drawn) // DRAWN_BOX) if n_bases > DRAWN else n_bases))

    def dealt(rows: DataFrame, more: list[str]) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = arrow_matrix(pa.chunked_array([batch["vi"]]), pa.chunked_array([batch["vv"]]), width)
                yield batch.append_column("box", pa.array(boxes.of(x), pa.int64()))

        rows = rows.select("vi", "vv", "qid", *more)
        return rows.mapInArrow(deal, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", box long")

    asks = dealt(asks.withColumn("held", F.size("ids")), ["held"])
    bases = freeze(dealt(bases, ["ids"]))
    edge = lambda f, name: [f(F.get("vv", F.lit(d))).alias(f"{name}{d}") for d in range(width)]
    ends = {r.box: r for r in bases.groupBy("box").agg(*edge(F.min, "low"), *edge(F.max, "high")).collect()}
    names = np.array(sorted(ends))
    low, high = (np.array([[ends[b][f"{side}{d}"] for d in range(width)] for b in names.tolist()]) for side in ("low", "high"))

    def met(asks: DataFrame, meet, schema: str) -> DataFrame:
        """Queries with the base rows of their box, at most about BOX_ASKS in a task."""
        parts = F.broadcast(asks.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / BOX_ASKS).cast("int").alias("parts")))
        left = asks.join(parts, "box").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts"))).drop("parts")
        right = bases.join(parts, "box").select(
            F.col("box").alias("base_box"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("base_part"), "vi", "vv", "qid", "ids"
        )
        return left.groupBy("box", "part").cogroup(right.groupBy("base_box", "base_part")).applyInArrow(meet, schema)

    def at_home(ask: pa.Table, base: pa.Table) -> pa.Table:
        need = _wanted(ask, k, skip_self)
        rows, gaps, members = _lists_in(ask, base, need, width)
        size = np.bincount(rows, minlength=len(ask))
        first = np.cumsum(size) - size
        reach = np.where(size < need, np.inf, -1.0)
        some = (size >= need) & (size > 0)
        reach[some] = gaps[first[some] + size[some] - 1]
        x = arrow_matrix(ask["vi"], ask["vv"], width)
        home = ask["box"][0].as_py() if len(ask) else 0
        out = np.flatnonzero((reach >= 0) & (boxes.inside(x, home) <= reach * (1 + 1e-9)))
        point, box = reached(x[out], reach[out], low, high, HELD)
        point, box = out[point], names[box]
        point, box = point[box != home], box[box != home]
        others = np.bincount(point, minlength=len(ask))
        lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
        entry = pa.StructArray.from_arrays([pa.array(gaps), pa.array(members)], ["dist", "id"])
        return pa.table({
            "qid": ask["qid"], "vv": ask["vv"], "held": ask["held"], "far": lists(size, entry), "reach": pa.array(reach), "boxes": lists(others, pa.array(box, pa.int64()))
        })

    near = freeze(met(freeze(asks), at_home, "qid long, vv array<double>, held int, far array<struct<dist:double,id:long>>, reach double, boxes array<long>"))
    if (near.agg(F.sum(F.size("boxes"))).first()[0] or 0) > MOST_BOXES * n_asks:
        return None

    def abroad(ask: pa.Table, base: pa.Table) -> pa.Table:
        rows, gaps, members = _lists_in(ask, base, _wanted(ask, k, skip_self), width)
        kept = gaps <= ask["reach"].to_numpy()[rows]
        return pa.table({"qid": pa.array(ask["qid"].to_numpy()[rows[kept]], pa.int64()), "dist": pa.array(gaps[kept]), "id": pa.array(members[kept])})

    open_ = near.filter(F.size("boxes") > 0)
    visits = freeze(open_.select(F.explode("boxes").alias("box"), "qid", F.lit(None).cast("array<int>").alias("vi"), "vv", "held", "reach"))
    entries = met(visits, abroad, ENTRIES).select("qid", F.struct("dist", "id").alias("e"))
    settled = near.filter(F.size("boxes") == 0).select("qid", "far")
    return settled.unionByName(_first(open_.select("qid", F.explode("far").alias("e")).unionByName(entries), k))


def _search(vectors, queries, k, width, skip_self, side, n_queries):
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    vectors = freeze(vectors)
    many = vectors.count() > side
    best = _by_boxes(vectors, k, width, skip_self, min(side, BOX_ROWS)) if many and 0 < width <= FEW_WIDTH else None

    def meet(ask: pa.Table, base: pa.Table) -> pa.Table:
        base = base.rename_columns([c.removeprefix("base_") for c in base.column_names])
        return _nearest_in(ask, base, _wanted(ask, k, skip_self), width)

    if best is None:
        if many:
            left, right = _blocks(vectors, min(side, max(128, BLOCK_BYTES // (8 * max(width, 1)))), cores)
            found = meetings(left, right, lambda a, ask, b, base: meet(ask, base), ENTRIES)
        else:
            keys = ["a", "b"]
            left, right = grid(vectors, side, cores)
            right = right.withColumnsRenamed({c: f"base_{c}" for c in right.columns})  # both sides come from one frame
            found = left.groupBy(*keys).cogroup(right.groupBy(*[f"base_{c}" for c in keys])).applyInArrow(meet, ENTRIES)
        best = _first(found.select("qid", F.struct("dist", "id").alias("e")), k)
    asks = vectors.filter("qid IS NOT NULL")
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("id")))
    empty = F.array().cast("array<struct<dist:double,id:long>>")
    merged = asks.select("qid", own.alias("own")).join(best, "qid", "left").select(
        "qid", F.slice(F.sort_array(F.concat("own", F.coalesce("far", empty))), 1, k + 1).alias("nn")
    )
    if asks.count() == n_queries:
        return merged.withColumnRenamed("qid", "row_id")
    # Copies among the queries: hand every copy the list of its vector. A hot
    # vector sits on the row side, which adaptive execution splits.
    names = asks.select(F.col("h").alias("nh"), F.col("vi").alias("ni"), F.col("vv").alias("nv"), "qid")
    hashed = queries.withColumn("h", F.xxhash64("vi", "vv"))
    same = (F.col("h") == F.col("nh")) & (F.col("vv") == F.col("nv")) & F.col("vi").eqNullSafe(F.col("ni"))
    mapped = hashed.join(names, same).select(F.col("id").alias("row_id"), "qid")
    return mapped.join(merged, "qid").select("row_id", "nn")


def nearest(
    queries: DataFrame,
    base: DataFrame | None = None,
    k: int = 5,
    include_self: bool = False,
    key: str = "row_id",
    features: str = "features",
    rows_per_side: int | None = None,
) -> DataFrame:
    """``(row_id, nn)``: the k nearest base rows, ``nn`` an ordered array of (dist, id).

    Without ``base`` the queries search themselves and a row is not its own
    neighbour unless ``include_self``. Ties go to the smaller id.
    """
    width = vector_width(queries if base is None else base, features)
    asked = unpacked(queries, key, features, width)
    self_join = base is None
    if self_join:
        rows = asked.withColumn("is_query", F.lit(True)).withColumn("is_base", F.lit(True))
    else:
        held = unpacked(base, key, features, width)
        rows = asked.withColumn("is_query", F.lit(True)).withColumn("is_base", F.lit(False)).unionByName(
            held.withColumn("is_query", F.lit(False)).withColumn("is_base", F.lit(True))
        )
    skip_self = self_join and not include_self
    vectors = _distinct(rows, k + 1, self_join).select("h", "vi", "vv", "ids", "qid")
    side = rows_per_side or side_rows(width)
    lists = _search(vectors, asked, k, width, skip_self, side, asked.count())
    kept = F.filter("nn", lambda e: e["id"] != F.col("row_id")) if skip_self else F.col("nn")
    return lists.select("row_id", F.slice(kept, 1, k).alias("nn"))


def graph(lists: DataFrame) -> DataFrame:
    """Edge form ``(row_id, rank, nbr_id, dist)`` of the neighbour lists."""
    return lists.select("row_id", F.posexplode("nn").alias("rank", "e")).select(
        "row_id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("nbr_id"), F.col("e.dist").alias("dist")
    )
