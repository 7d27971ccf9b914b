"""Records of large CSV files, read by many tasks although quoted cells may hold line breaks.

Files are split as Spark splits text. Whether a split starts inside a quoted cell depends on all before it, so a first
pass tells for each split how it ends from either start (a transition of the quote state machine); the transitions are
put together on the driver, a few bytes a split. The second pass then knows each split's start: it hands on whole
records, and the pieces of a record that crosses splits, which are joined by the place where the record begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

QUOTE = '"'


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open after the line; a quote opens a cell only as its first character."""
    at = 0
    while True:
        if not inside:
            if line.startswith(QUOTE, at):
                at += 1
            else:
                found = line.find(sep, at)
                if found < 0:
                    return False
                at = found + len(sep)
                continue
        found = line.find(QUOTE, at)
        if found < 0:
            return True
        if line.startswith(QUOTE, found + 1):  # two quotes stand for one
            inside, at = True, found + 2
            continue
        found = line.find(sep, found + 1)
        if found < 0:
            return False
        inside, at = False, found + len(sep)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): lines with the split they are in, in file order inside a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """Runs of lines of one split."""
    if not batch.num_rows:
        return
    start = batch.column(1).to_numpy()
    file = batch.column(0).dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield batch.column(0)[low].as_py(), int(start[low]), batch.column(2)[low:high]


def _states(lines: pa.Array, inside: bool, sep: str) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside a cell, and whether the last one ends so. Only lines with quotes are looked at."""
    before = np.empty(len(lines), bool)
    done = 0
    for k in np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False)):
        before[done : k + 1] = inside
        inside, done = ends_inside(lines[k].as_py(), inside, sep), k + 1
    before[done:] = inside
    return before, inside


# How a split ends, and whether a record begins in it, from a start outside and inside a cell.
TRANSITIONS = "file string, start bigint, out_ends boolean, out_begins boolean, in_ends boolean, in_begins boolean"


def transitions(lines: DataFrame, sep: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for file, start, part in _stretches(batch):
                state = found.setdefault((file, start), [False, False, True, False])
                for k in (0, 2):
                    before, state[k] = _states(part, state[k], sep)
                    state[k + 1] |= not before.all()
        rows = [(*key, *state) for key, state in found.items()]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in TRANSITIONS.split(", ")])

    return lines.mapInArrow(read, TRANSITIONS)


def joined(found: list) -> tuple[dict[tuple[str, int], int], set[tuple[str, int]]]:
    """Splits that start inside a cell, with the split its record begins in; and splits whose last record goes on."""
    inner, open_ = {}, set()
    file, inside, owner = None, False, 0
    for row in sorted(found, key=lambda r: (r.file, r.start)):
        if row.file != file:
            file, inside, owner = row.file, False, row.start
        if inside:
            inner[file, row.start] = owner
        begins, inside = (row.in_begins, row.in_ends) if inside else (row.out_begins, row.out_ends)
        if begins:
            owner = row.start
        if inside:
            open_.add((file, owner))
    return inner, open_


PIECES = "file string, start bigint, line bigint, piece bigint, text string"


def _pieces(lines: DataFrame, sep: str, inner: dict[tuple[str, int], int], open_: set[tuple[str, int]]) -> DataFrame:
    """(file, start, line, piece, text): records by the split and line they begin at.

    `piece` is null for a whole record. Pieces of one that crosses splits have the line -1 and the split they stand in.
    """

    def emit(file: str, at: int, line: list[int], text: list[str], piece: int | None = None) -> pa.RecordBatch:
        n = len(text)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array(line, pa.int64()), pa.array([piece] * n, pa.int64()), pa.array(text, pa.string())],
            [c.split()[0] for c in PIECES.split(", ")],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[str, int] | None = None
        held: list[str] = []  # lines of the record at hand
        began, n_lines, inside = -1, 0, False

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            """Hand on what is held: a piece if it belongs to an earlier split or is the open end of this one."""
            if key is None or not held:
                return
            text = "\n".join(held)
            if began < 0:
                yield emit(key[0], inner[key], [-1], [text], key[1])
            elif last and key in open_:
                yield emit(key[0], key[1], [-1], [text], key[1])
            else:
                yield emit(key[0], key[1], [began], [text])

        for batch in batches:
            for file, start, part in _stretches(batch):
                if (file, start) != key:
                    yield from close(True)
                    key, held, began, n_lines, inside = (file, start), [], -1, 0, (file, start) in inner
                before, inside = _states(part, inside, sep)
                firsts = np.flatnonzero(~before)
                texts = part.to_pylist()
                if not len(firsts):
                    held.extend(texts)
                else:
                    held.extend(texts[: firsts[0]])
                    yield from close(False)
                    stops = firsts[1:].tolist()
                    yield emit(file, start, (n_lines + firsts[:-1]).tolist(), ["\n".join(texts[a:b]) for a, b in zip(firsts[:-1].tolist(), stops)])
                    held, began = texts[firsts[-1] :], n_lines + int(firsts[-1])
                n_lines += len(texts)
        yield from close(True)

    return lines.mapInArrow(read, PIECES)


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(_file, _start, _line, _text): every record but blank ones and each file's first, the header."""
    lines = split_lines(spark, path)
    inner, open_ = joined(transitions(lines, sep).collect())
    found = _pieces(lines, sep, inner, open_)
    whole = found.filter("piece IS NULL").select("file", "start", "line", "text")
    if open_:
        parts = found.filter("piece IS NOT NULL").groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"))
        # The open record of a split is its last one.
        crossing = parts.select("file", "start", F.lit(2**62).alias("line"), F.array_join(F.col("parts.text"), "\n").alias("text"))
        whole = whole.unionByName(crossing)
    text = F.when(F.col("text").endswith("\r"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    out = whole.select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("line").alias("_line"), text.alias("_text"))
    first = (F.col("_start") == 0) & (F.col("_line") == 0)
    if any(start == 0 for _, start in open_):
        # A header that itself crosses splits has no line of its own; it is all its split holds.
        lone = {file for file, start in open_ if start == 0}
        alone = whole.filter((F.col("start") == 0) & F.col("file").isin(*lone)).groupBy("file").agg(F.min("line").alias("least")).filter(f"least = {2**62}")
        headers = [r.file for r in alone.collect()]
        if headers:
            first = first | ((F.col("_start") == 0) & F.col("_file").isin(*headers))
    return out.filter(~first & (F.col("_text") != ""))
