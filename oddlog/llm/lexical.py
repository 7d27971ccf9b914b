"""Ranked lexical search on K2-treaps, one for each slice of documents.

The grid has a row for each term of the items and a column for each document of the slice; a point holds the term's
impact in the document. A quadtree halves rows and columns at once, keeps only cells that hold a point, and each cell
keeps the largest impact in it. An item follows the paths of all its rows together: a state is a range of documents
with the cell of each row, its bound is the weighed sum of the cells' maxima, and states are opened best first until no
bound reaches the score of the last place. Lower levels split columns and rows alike, so bounds become the score.

Counts over all documents (N, L, df) come first, in one pass. A task keeps the best of its own slices and starts each
slice with their last score as the bar; the best of all tasks are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from oddlog.llm.words import Words, slices

TOP = 20
SLICE = 16 << 20  # bytes of text of one tree
OPEN = 64  # states opened at once
ITEM_TERMS = 1 << 20  # terms of the items that one pass looks for


class Treap:
    """Quadtree of (row, column, impact) points with the largest impact of each cell.

    Cells of all levels are numbered one after another from 1; 0 is the empty cell. `child[c, 2 * row bit + column bit]`.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray) -> None:
        self.depth = max(int(row.max(initial=0)), int(column.max(initial=0))).bit_length()
        code = np.zeros(len(row), np.uint64)
        for b in range(self.depth):
            pair = (((row >> b) & 1) << 1 | ((column >> b) & 1)).astype(np.uint64)
            code |= pair << np.uint64(2 * b)
        order = np.argsort(code)
        code, top = code[order], impact[order]
        levels = [(code, top)]
        for _ in range(self.depth):
            up = code >> np.uint64(2)
            first = np.flatnonzero(np.diff(up, prepend=up[:1] + np.uint64(1))) if len(up) else np.zeros(0, np.int64)
            code, top = up[first], np.maximum.reduceat(top, first) if len(first) else top
            levels.append((code, top))
        levels.reverse()
        starts = 1 + np.concatenate([[0], np.cumsum([len(c) for c, _ in levels])])
        self.most = np.concatenate([[0], *[t for _, t in levels]]).astype(np.int64)
        self.child = np.zeros((len(self.most), 4), np.int32)
        for k in range(self.depth):
            below = levels[k + 1][0]
            owner = starts[k] + np.searchsorted(levels[k][0], below >> np.uint64(2))
            self.child[owner, (below & np.uint64(3)).astype(np.int64)] = starts[k + 1] + np.arange(len(below))

    def best(self, row: np.ndarray, weight: np.ndarray, top: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) that hold, with ties, the `top` best columns of score `bar` or more."""
        none = np.zeros(0, np.int64)
        if len(self.most) == 1 or not len(row):
            return none, none
        cells = np.ones((1, len(row)), np.int32)
        bound = np.array([self.most[1] * weight.sum()])
        level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        found_c, found_s = none, none
        halves = np.arange(2)
        while len(bound):
            keep = bound >= bar
            if not keep.all():
                cells, bound, level, column = cells[keep], bound[keep], level[keep], column[keep]
                continue
            if len(bound) > OPEN:
                order = np.argpartition(-bound, OPEN)
                now, later = order[:OPEN], order[OPEN:]
            else:
                now, later = np.arange(len(bound)), none
            ended = level[now] == self.depth
            if ended.any():
                done = now[ended]
                found_c, found_s = np.concatenate([found_c, column[done]]), np.concatenate([found_s, bound[done]])
                if len(found_s) > top:
                    bar = max(bar, int(np.partition(found_s, -top)[-top]))
                    good = found_s >= bar
                    found_c, found_s = found_c[good], found_s[good]
                elif len(found_s) == top:
                    bar = max(bar, int(found_s.min()))
            going = now[~ended]
            bits = (row[None, :] >> (self.depth - 1 - level[going])[:, None]) & 1
            below = self.child[cells[going][:, :, None], 2 * bits[:, :, None] + halves]  # state, row, half
            sums = np.tensordot(weight, self.most[below], (0, 1))
            below, sums = below.transpose(0, 2, 1).reshape(-1, len(row)), sums.reshape(-1)
            at = (2 * column[going][:, None] + halves).reshape(-1)
            good = (sums >= bar) & (sums > 0)
            cells = np.concatenate([cells[later], below[good]])
            bound = np.concatenate([bound[later], sums[good]])
            level = np.concatenate([level[later], np.repeat(level[going] + 1, 2)[good]])
            column = np.concatenate([column[later], at[good]])
        return found_c, found_s


def _grid(words: Words, data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and the (term, text, count) points of the vocabulary's terms."""
    hashes, ends = words.hashes(data, offsets)
    sizes = np.diff(ends)
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    met = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
    text = np.searchsorted(ends, met, "right") - 1
    pair, count = np.unique(at[met] * len(sizes) + text, return_counts=True)
    return sizes, pair // max(len(sizes), 1), pair % max(len(sizes), 1), count


def _items(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(item_id, its term hashes) in blocks of ITEM_TERMS terms or one item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True, keep_marks=False)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                hashes, ends = words.hashes(data, offsets)
                packed = pa.array([hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], packed], ["item_id", "terms"])

    block, size = [], 0
    for row in items.mapInArrow(read, "item_id bigint, terms binary").toLocalIterator():
        terms = np.frombuffer(row.terms, np.uint64)
        if block and size + len(terms) > ITEM_TERMS:
            yield block
            block, size = [], 0
        block.append((row.item_id, terms))
        size += len(terms)
    if block:
        yield block


def corpus_counts(texts: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Texts with a term, terms of all texts, and texts that hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, total, df = Words(lower=True, keep_marks=False), 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sizes, term, _, _ = _grid(words, data, offsets, vocabulary)
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
                df += np.bincount(term, minlength=len(vocabulary))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], held]), pa.int32()), pa.array(np.concatenate([[n, total], df[held]]), pa.int64())], ["term", "n"]
        )

    df = np.zeros(len(vocabulary) + 2, np.int64)
    for row in texts.mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[row.term] = row.n  # -2 and -1 count from the end
    return int(df[-2]), int(df[-1]), df[:-2]


RANKED = "item_id bigint, doc_id bigint, score bigint"


def _ranked(rows: DataFrame, block: list[tuple[int, np.ndarray]], top: int) -> DataFrame:
    """The best documents of each item of the block in each task."""
    vocabulary = np.unique(np.concatenate([t for _, t in block]))
    n_texts, n_terms, df = corpus_counts(rows.select("text"), vocabulary)
    weight = np.array([math.floor(1000 * math.log((2 * n_texts + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    # Rows of like frequency share cells, so that a cell's maximum says something about each.
    place = np.empty(len(vocabulary), np.int64)
    place[np.lexsort((vocabulary, df))] = np.arange(len(vocabulary))
    asked = []
    for _, terms in block:
        term, times = np.unique(np.searchsorted(vocabulary, terms), return_counts=True)
        use = (weight[term] > 0) & (df[term] > 0)
        asked.append((place[term[use]], weight[term[use]] * times[use]))
    ids = [i for i, _ in block]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True, keep_marks=False)
        score = [np.zeros(0, np.int64)] * len(asked)
        doc = [pa.array([], pa.int64())] * len(asked)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1), SLICE):
                sizes, term, text, tf = _grid(words, data, offsets, vocabulary)
                if not len(term):
                    continue
                m = 75 + 25 * sizes * n_texts // n_terms
                tree = Treap(place[term], text, 1_000_000_000 * tf // (1000 * tf + 12 * m[text]))
                own = batch.column(0)[low:high]
                for k, (row, weights) in enumerate(asked):
                    bar = int(score[k].min()) if len(score[k]) == top else 1
                    column, s = tree.best(row, weights, top, bar)
                    if len(column):
                        docs, scores = pa.concat_arrays([doc[k], own.take(pa.array(column))]), np.concatenate([score[k], s])
                        missing, at = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
                        best = np.lexsort((at, missing, -scores))[:top]
                        doc[k], score[k] = docs.take(pa.array(best)), scores[best]
        for item, docs, scores in zip(ids, doc, score):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(scores), pa.int64()), docs, pa.array(scores)], [c.split()[0] for c in RANKED.split(", ")])

    return rows.mapInArrow(search, RANKED)


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of highest score above 0 of each item.

    Terms are runs of ASCII letters and digits and of all other code points above 127, A-Z lower-cased; null texts have
    none and items without terms give no rows. Equal scores go by doc_id, null ids last; rows that repeat an id are
    ranked as rows of their own, and so are items that repeat one (under one id, ranks run through the rows of both).
    Other columns are not looked at. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wanted = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    found = None
    for block in _items(wanted):
        part = _ranked(rows, block, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # The best of all tasks in two steps, as an item has as many lists as there are tasks.
    share = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*by)
    some = found.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by))).filter(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
