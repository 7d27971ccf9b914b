"""Which keys occur more than once, among keys too many to shuffle as rows.

Keys travel as packed arrays with the place they were seen at: a row of the shuffle holds all keys of one slice of
texts that belong to one part of the key space. A slice sends each key once, however often it has it, so a key that a
third of all texts share is as many entries as there are slices. Parts are two to a shuffle partition, each sorted
in one task's memory; `spark.sql.shuffle.partitions` is what keeps them small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oddlog.llm.words import mix

PACKED = "part int, key binary, proof binary, row binary, pos binary, known binary"
_NAMES = [c.split()[0] for c in PACKED.split(", ")]
FOUND = "row bigint, pos binary"


def _pack(values: np.ndarray) -> bytes:
    """Differences of neighbours, which compress well where places follow each other."""
    return np.diff(values, prepend=values.dtype.type(0)).tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, kind), dtype=kind)


def pack(key: np.ndarray, proof: np.ndarray, row: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Send keys (uint64, and a uint32 more as proof) of places (row, pos) of one slice."""
    if not len(key):
        return
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    mixed = np.zeros(len(first), bool)
    mixed[inverse[proof != proof[first][inverse]]] = True
    several = ((count > 1) & ~mixed)[inverse]
    sent = np.zeros(len(key), bool)
    sent[first] = True
    sent |= mixed[inverse]
    at = np.flatnonzero(sent)
    of = ((key[at] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    at, of = at[order], of[order]
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    rows = [
        (int(of[low]), key[i].tobytes(), proof[i].tobytes(), _pack(row[i]), _pack(pos[i]), np.packbits(several[i]).tobytes())
        for low, high in zip(cuts, [*cuts[1:], len(at)])
        for i in [at[low:high]]
    ]
    if several.any():  # repeated here already: only their places go on
        rows.append((int(key[0] % np.uint64(parts)), b"", b"", _pack(row[several]), _pack(pos[several]), b""))
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], _NAMES)


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the runs of `values` that end at `ends`."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _columns(table: pa.Table, *names: str) -> Iterator[tuple]:
    for batch in table.to_batches():
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, pos) of a part whose key another place has too."""
    keys, proofs, rows, places, knowns, out_rows, out_pos = [], [], [], [], [], [], []
    for key, proof, row, pos, known in _columns(table, *_NAMES[1:]):
        row, pos = _unpack(row, np.int64), _unpack(pos, np.int32)
        if key:
            keys.append(np.frombuffer(key, np.uint64))
            proofs.append(np.frombuffer(proof, np.uint32))
            knowns.append(np.unpackbits(np.frombuffer(known, np.uint8))[: len(row)].astype(bool))
            rows.append(row)
            places.append(pos)
        else:
            out_rows.append(row)
            out_pos.append(pos)
    if keys:
        key, proof, row, pos, known = map(np.concatenate, (keys, proofs, rows, places, knowns))
        order = np.lexsort((proof, key))
        key, proof, row, pos, known = key[order], proof[order], row[order], pos[order], known[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (proof[1:] != proof[:-1])
        start = np.flatnonzero(new)
        several = (np.diff(np.append(start, len(key))) > 1) | np.logical_or.reduceat(known, start)
        told = several[np.cumsum(new) - 1] & ~known
        out_rows.append(row[told])
        out_pos.append(pos[told])
    return np.concatenate(out_rows), np.concatenate(out_pos)


def _by_row(table: pa.Table) -> pa.Table:
    """All places of the rows of a bucket, one record a row."""
    parts = [(_unpack(row, np.int64), _unpack(pos, np.int32)) for row, pos in _columns(table, "row", "pos")]
    row, pos = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    starts = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
    return pa.table({"row": pa.array(row[starts], pa.int64()), "pos": _binaries(pos, np.append(starts[1:], len(row)))})


def places(packed: DataFrame, buckets: int) -> DataFrame:
    """(row, pos) of all places whose key occurs at two places or more: a record a row, pos its ascending int32 values.

    Answers go back packed as well, a record for each part and bucket of rows.
    """

    def answer(table: pa.Table) -> pa.Table:
        row, pos = _told(table)
        of = (mix(row.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((pos, row, of))
        of, row, pos = of[order], row[order], pos[order]
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        runs = list(zip(cuts, [*cuts[1:], len(of)]))
        return pa.table({
            "bucket": pa.array(of[cuts], pa.int32()), "row": pa.array([_pack(row[a:b]) for a, b in runs], pa.binary()),
            "pos": pa.array([_pack(pos[a:b]) for a, b in runs], pa.binary()),
        })

    answers = packed.groupBy("part").applyInArrow(answer, "bucket int, row binary, pos binary")
    return answers.groupBy("bucket").applyInArrow(_by_row, FOUND)
