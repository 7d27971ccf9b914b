"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword; each bit parts the languages in two, and a linear n-gram classifier of that bit says how
far a text is on which side. n-gram counts by language are taken once, over all learning rows; a bit's weights are the
log ratio of an n-gram's mean share in the languages of either side, as whole numbers, so that sums do not depend on
order. A second pass over the learning rows measures each bit: how large its margins are and how often it is wrong.
Decoding takes the codeword of least weighed hinge loss, where a bit that is often wrong counts little; a text whose two
nearest codewords are about as near is flagged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.llm.common import shuffle_parts
from oddlog.llm.words import mix, slices

GRAMS = (1, 2, 3, 4)  # bytes of an n-gram
BUCKETS = 1 << 15
UNIT = 1024  # a weight of 1
EXHAUSTIVE = 6  # languages up to which all partings in two are bits
AMBIGUOUS = 0.8  # scores below are flagged
UNKNOWN = "und"
_STEP = 1 << 16  # bytes of text looked at together


def letters(text: Column) -> Column:
    """Lower-cased letters and marks, other runs as one space, a space on either side; a null text is one space."""
    plain = F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{M}]+", " ")
    return F.concat(F.lit(" "), F.trim(F.coalesce(plain, F.lit(""))), F.lit(" "))


def held_out(id_column: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 by 4; a null id does not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each language: all partings in two of a few languages, else the best of hashed codes."""
    if n <= 1:
        return np.ones((n, 1), np.int64)
    if n <= EXHAUSTIVE:
        bits = (np.arange(1, 1 << (n - 1))[None, :] >> np.arange(n)[:, None]) & 1
        return 2 * bits - 1
    length, best, code = math.ceil(10 * math.log2(n)), -1, None
    for seed in range(50):
        raw = mix(np.arange(n * length, dtype=np.uint64) + np.uint64(seed << 32) + np.uint64(1)).reshape(n, length)
        tried = np.where(raw & np.uint64(1), 1, -1).astype(np.int64)
        apart = (length - tried @ tried.T) // 2
        least = int((apart + length * np.eye(n, dtype=np.int64)).min())
        if least > best and (np.abs(tried.sum(0)) < n).all():
            best, code = least, tried
    return code


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first text, starts of texts, buckets of each size) of stretches of bytes; bucket BUCKETS is no n-gram.

    Each place is the start of an n-gram of every size, as far as it ends in its text; the stretches overlap no place.
    """
    stop = int(offsets[-1])
    for low in range(int(offsets[0]), stop, _STEP):
        high = min(low + _STEP, stop)
        first = int(np.searchsorted(offsets, low, "right")) - 1
        last = int(np.searchsorted(offsets, high, "left")) - 1
        starts = np.maximum(offsets[first : last + 1], low) - low
        # As each text has two bytes or more, `ends` has a text's end for every place.
        ends = np.repeat(offsets[first + 1 : last + 2], np.diff(np.append(starts, high - low)))
        key = np.zeros(high - low, np.uint64)
        place = np.arange(low, high)
        found = []
        for n in range(1, max(GRAMS) + 1):
            byte = np.zeros(high - low, np.uint8)
            there = data[low + n - 1 : min(high + n - 1, len(data))]
            byte[: len(there)] = there
            key = (key << np.uint64(8)) | byte.astype(np.uint64)
            if n in GRAMS:
                bucket = (mix(key + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64)
                bucket[place + n > ends] = BUCKETS
                if n == 1:
                    bucket[byte == 32] = BUCKETS
                found.append(bucket)
        yield first, starts, found


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # a row for each language
    weights: np.ndarray  # BUCKETS + 1 rows, a column for each bit
    margin: np.ndarray  # size of each bit's usual margin
    trust: np.ndarray  # weight of each bit in the loss

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean weight of the n-grams of each text, a column for each bit, in units of the bit's usual margin."""
        n = len(offsets) - 1
        total, count = np.zeros((n, self.weights.shape[1]), np.int64), np.zeros(n, np.int64)
        tables = [np.ascontiguousarray(w) for w in self.weights.T]  # a stretch of one bit's sums stays in cache
        for first, starts, found in grams(data, offsets):
            at = slice(first, first + len(starts))
            for b, table in enumerate(tables):
                each = table.take(found[0])
                for bucket in found[1:]:
                    each += table.take(bucket)
                total[at, b] += np.add.reduceat(each, starts, dtype=np.int64)
            for bucket in found:
                count[at] += np.add.reduceat(bucket < BUCKETS, starts, dtype=np.int64)
        return total / np.maximum(count, 1)[:, None] / self.margin

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, score) of the nearest codeword; the score is its share among exp(-loss)."""
        loss = np.maximum(0.0, 1.0 - margins[:, None, :] * self.code[None]) @ self.trust
        near = np.exp(-4.0 * (loss - loss.min(1, keepdims=True)) / self.trust.sum())
        near /= near.sum(1, keepdims=True)
        best = near.argmax(1)
        return best, near[np.arange(len(best)), best]


def _total(rows: DataFrame, parts: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums of packed counts of all tasks by (language, stripe), added as they stream by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for l, s, data in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(data, np.int64)
                total[l, s] = total[l, s] + values if (l, s) in total else values
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            ["language", "stripe", "counts"],
        )

    out = rows.repartition(parts, "language", "stripe").mapInArrow(add, "language int, stripe int, counts binary").collect()
    return {(r.language, r.stripe): np.frombuffer(r.counts, np.int64) for r in out}


STRIPES = 16
COUNTED = "language int, stripe int, counts binary"


def _learning(docs: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    number = F.create_map(*[F.lit(x) for k, l in enumerate(languages) for x in (l, k)])
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.select(number[F.col("lang").cast("string")].cast("int").alias("language"), letters(F.col("text")).alias("plain"))


def gram_counts(learning: DataFrame, n: int) -> np.ndarray:
    """n-gram counts by language over all learning rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n * (BUCKETS + 1), np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            for low, _, data, offsets in slices(batch.column(1)):
                for first, starts, buckets in grams(data, offsets):
                    of = np.repeat(own[low + first : low + first + len(starts)], np.diff(np.append(starts, len(buckets[0])))) * (BUCKETS + 1)
                    found += np.bincount(np.concatenate([of + bucket for bucket in buckets]), minlength=len(found))
        striped = found.reshape(n, -1)[:, :BUCKETS].reshape(n * STRIPES, -1)
        held = np.flatnonzero(striped.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held // STRIPES, pa.int32()), pa.array(held % STRIPES, pa.int32()), pa.array([striped[k].tobytes() for k in held], pa.binary())], [c.split()[0] for c in COUNTED.split(", ")]
        )

    parts = min(n * STRIPES, shuffle_parts(learning.sparkSession))
    out = np.zeros((n, STRIPES, BUCKETS // STRIPES), np.int64)
    for (language, stripe), values in _total(learning.mapInArrow(count, COUNTED), parts).items():
        out[language, stripe] = values
    return out.reshape(n, -1)


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log ratio of an n-gram's mean share in the languages of 1 and of -1; 0 where counts say nothing."""
    smooth = counts + 0.5
    share = smooth / smooth.sum(1, keepdims=True)
    sides = [np.stack([share[code[:, b] == side].mean(0) if (code[:, b] == side).any() else np.full(BUCKETS, 1 / BUCKETS) for b in range(code.shape[1])], 1) for side in (1, -1)]
    weights = np.rint(UNIT * np.log(sides[0] / sides[1])).astype(np.int32)
    weights[counts.sum(0) == 0] = 0
    return np.concatenate([weights, np.zeros((1, code.shape[1]), np.int32)])


def _bit_quality(learning: DataFrame, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Mean size of each bit's margin and share of learning rows on its wrong side; languages count alike."""
    n, bits = model.code.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((n, 1 + 2 * bits), np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            for low, high, data, offsets in slices(batch.column(1)):
                margins = model.margins(data, offsets)
                of, sides = own[low:high], model.code[own[low:high]]
                found[:, 0] += np.bincount(of, minlength=n)
                for b in range(bits):
                    # Whole units, so that order cannot change the sum.
                    found[:, 1 + b] += np.bincount(of, np.rint(np.abs(margins[:, b])), n).astype(np.int64)
                    found[:, 1 + bits + b] += np.bincount(of, margins[:, b] * sides[:, b] <= 0, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n), pa.int32()), pa.array([0] * n, pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())], [c.split()[0] for c in COUNTED.split(", ")]
        )

    sums = _total(learning.mapInArrow(measure, COUNTED), min(n, shuffle_parts(learning.sparkSession)))
    table = np.array([sums[k, 0] for k in range(n)])
    each = table[:, 1:] / np.maximum(table[:, :1], 1)
    return np.maximum(each[:, :bits].mean(0), 1.0), each[:, bits:].mean(0)


def fit(docs: DataFrame) -> LanguageModel | None:
    """Learn from text and lang of all rows that are not held out; None if none of them has a lang."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang")).distinct().collect()
    languages = tuple(sorted(r.lang for r in known))
    if not languages:
        return None
    code = codewords(len(languages))
    learning = _learning(docs, languages)
    weights = bit_weights(gram_counts(learning, len(languages)), code)
    plain = LanguageModel(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
    margin, wrong = _bit_quality(learning, plain)
    wrong = np.clip(wrong, 0.001, 0.499)
    return LanguageModel(languages, code, weights, margin, np.log((1 - wrong) / wrong))


OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean"


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), a row for each row given.

    A null text and one without a letter are `und` with score 0, and so is every text if nothing could be learnt. One
    learnt language is the answer for every other text. Whole texts count, copies alike; rows that repeat an id are
    rows of their own and a null id stays. Other columns are not looked at. An empty table gives an empty result.
    """
    has = F.coalesce(F.regexp_like(F.col("text").cast("string"), F.lit(r"\p{L}")), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), has.alias("has"), letters(F.col("text")).alias("plain"))
    names = [c.split()[0] for c in OUT.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(3)):
                m = high - low
                has = batch.column(2)[low:high].to_numpy(zero_copy_only=False).astype(bool) & (model is not None)
                best, score = model.decode(model.margins(data, offsets)) if model else (np.zeros(m, np.int64), np.zeros(m))
                spoken = pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)], pa.string())
                score = np.where(has, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], spoken, pa.array(score), pa.array(score < AMBIGUOUS)], names)

    return rows.mapInArrow(read, OUT)
