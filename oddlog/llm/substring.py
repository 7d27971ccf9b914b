"""Substring dedup by difference-cover anchors.

Positions whose remainder by PERIOD is in COVER are anchors. COVER has every remainder as a difference of two of its
members, so for two occurrences of a window of n words, at whatever positions, some shift below PERIOD puts both on
anchors; the n - PERIOD + 1 words from there are equal too. So only anchors (5 in 21 positions) are hashed, and
occurrences of a hash that occurs once are done with. Around the others, matches are extended: every window that holds
such an anchor is hashed over its full length (96 bits), and windows that occur twice or more cover what is removed.

Texts cross the network once; all else are packed places (see `repeats`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from oddlog.llm.common import shuffle_parts
from oddlog.llm.repeats import PACKED, pack, places
from oddlog.llm.words import Words, runs, slices

WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)  # a perfect difference set


def _spans(column, k: int) -> np.ndarray:
    return np.frombuffer(column[k].as_py() or b"", np.int32)


def anchors(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Packed anchors of texts of `window` words or more."""
    width = window - PERIOD + 1
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, high, data, offsets in slices(batch.column(1)):
                hashes, ends = words.hashes(data, offsets)
                n = np.diff(ends)
                row = np.repeat(np.arange(high - low), n)
                pos = np.arange(len(hashes)) - ends[row]
                at = np.flatnonzero(on[pos % PERIOD] & (pos + width <= n[row]) & (n[row] >= window))
                key = runs(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)
                yield from pack(key, np.zeros(len(at), np.uint32), ids[low:high][row[at]], pos[at].astype(np.int32), parts)

    return docs.mapInArrow(find, PACKED)


def windows(hit: DataFrame, window: int, parts: int) -> DataFrame:
    """Packed windows that hold a repeated anchor, from (row, text, pos of the anchors, ..)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, more = Words(), Words(seed=7)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, high, data, offsets in slices(batch.column(1)):
                hashes, ends = words.hashes(data, offsets)
                found = []
                for k in range(high - low):
                    n = ends[k + 1] - ends[k]
                    mark = np.zeros(n + 1, np.int32)
                    hits = _spans(batch.column(2), low + k)
                    np.add.at(mark, np.maximum(hits - (PERIOD - 1), 0), 1)
                    np.add.at(mark, hits + 1, -1)
                    found.append(np.flatnonzero(np.cumsum(mark)[: max(n - window + 1, 0)] > 0))
                row = np.repeat(np.arange(high - low), [len(f) for f in found])
                pos = np.concatenate(found).astype(np.int64)
                if len(pos):
                    at = ends[row] + pos
                    other, _ = more.hashes(data, offsets)
                    yield from pack(
                        runs(hashes, window)[at], (runs(other, window)[at] >> np.uint64(32)).astype(np.uint32),
                        ids[low:high][row], pos.astype(np.int32), parts,
                    )

    return hit.mapInArrow(find, PACKED)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed, kept_sha256), a row for each row given.

    Words are runs of anything but ASCII white space. A word goes if a window of `window` words of its document covers
    it whose words also start anywhere else, in this document or another; kept words are joined by one space. Rows
    that repeat a text (or a whole row) are different places. Null and empty texts have no words and keep an empty
    text. ``docs`` must come from storage, a checkpoint or a local table, so that a second reading numbers its rows
    alike. Other columns are not looked at.
    """
    if window < PERIOD:
        raise ValueError(f"windows below {PERIOD} words have no anchors")
    tasks = shuffle_parts(docs.sparkSession)
    parts, buckets = 2 * tasks, max(1, tasks // 2)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))
    hits = places(anchors(rows.select("row", "text"), window, parts), buckets)
    # Both joins ask for the same columns, so that one exchange of the texts serves both.
    spans = places(windows(rows.join(hits.hint("merge"), "row", "left").select("row", "text", "pos", "doc_id"), window, parts), buckets)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().split()
                gone, starts = 0, _spans(batch.column(2), k)
                kept = words
                if len(starts):
                    mark = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + window, -1)
                    stays = np.cumsum(mark)[:-1] == 0
                    gone, kept = int((~stays).sum()), compress(words, stays)
                joined = b" ".join(kept)
                for values, value in zip(out, (joined.decode(), len(words), gone, hashlib.sha256(joined).hexdigest())):
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()))]],
                ["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"],
            )

    joined = rows.join(spans.hint("merge"), "row", "left").select("doc_id", "text", "pos")
    id_type = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(keep, f"doc_id {id_type}, kept_text string, n_words bigint, n_removed bigint, kept_sha256 string")
