"""Severity of toxic texts by cumulative-link ordinal regression over sparse text features.

Features are which words a text has, and which openings of 4, 5, 6 and 8 bytes its longer words have, as 64-bit hashes of
lower-cased words. P(grade >= k) = sigmoid(w x - t_k) with one weight vector for all ordered thresholds t_1 < t_2 <
t_3. Labels only say toxic or not; toxic rows are graded 1 to 3 by thirds of how many of the chosen features they
have. A fit reads a bounded sample (`SAMPLE` rows) and keeps at most `FEATURES` features, so the table each scoring
task holds is bounded; scoring is a pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from oddlog.llm.quality import held_out, labelled_sample
from oddlog.llm.words import Words, mix, slices
from oddlog.session import freeze

SAMPLE = 20_000
FEATURES = 4_096
GRADES = 3
OPENINGS = (4, 5, 6, 8)
_BITS = 22


def text_features(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and opening of some texts, with repeats."""
    rows, features = [], []
    for place, starts, ends, sums in words.blocks(data, offsets):
        _, down = words._powers(len(sums))
        row = np.searchsorted(offsets, starts + place, "right") - 1
        rows.append(row)
        features.append(mix((sums[ends] - sums[starts]) * down[starts]))
        for n in OPENINGS:
            longer = np.flatnonzero(ends - starts > n)
            first = starts[longer]
            rows.append(row[longer])
            features.append(mix((sums[first + n] - sums[first]) * down[first] + np.uint64(n)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(features)


def _distinct(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((features, rows))
    rows, features = rows[order], features[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (features[1:] != features[:-1])
    return rows[new], features[new]


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def probabilities(self, totals: np.ndarray) -> np.ndarray:
        """P(grade >= k), a column for each k from 1."""
        return 1 / (1 + np.exp(-np.clip(totals[:, None] - self.thresholds[None, :], -500, 500)))

    def lookup(self) -> np.ndarray:
        there = np.zeros(1 << _BITS, bool)
        there[self.features >> np.uint64(64 - _BITS)] = True
        return there

    def totals(self, n: int, rows: np.ndarray, features: np.ndarray, there: np.ndarray) -> np.ndarray:
        near = there[features >> np.uint64(64 - _BITS)]
        rows, features = _distinct(rows[near], features[near])
        if not len(self.features):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        same = self.features[at] == features
        return np.bincount(rows[same], self.weights[at[same]], n)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, steps: int = 400, ridge: float = 1e-4):
    """(weights, thresholds) of the cumulative logit model of sparse 0/1 rows, by Adam on the likelihood."""
    n, top = len(grades), int(GRADES)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(width), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, steps + 1):
        t = np.concatenate([[-np.inf], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))]), [np.inf]])
        total = np.bincount(rows, p[columns], n)
        above, below = sigmoid(total - t[grades]), sigmoid(total - t[grades + 1])  # P(>= grade), P(> grade)
        likely = np.maximum(above - below, 1e-12)
        up, down = above * (1 - above) / likely, below * (1 - below) / likely
        of_total = -(up - down) / n
        of_t = np.bincount(np.concatenate([grades, grades + 1]), np.concatenate([up, -down]), top + 2)[1 : top + 1] / n
        later = np.cumsum(of_t[::-1])[::-1]
        grad = np.concatenate([np.bincount(columns, of_total[rows], width) + ridge * p[:width], later[:1], later[1:] * np.exp(p[width + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> OrdinalModel:
    """Learn from rows of `labels.toxic` that are not held out. Without both labels no text has any severity."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=True, keep_marks=False)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1), 1 << 20):
                rows, features = _distinct(*text_features(words, data, offsets))
                ends = np.searchsorted(rows, np.arange(high - low + 1))
                each = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(features.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], each], ["label", "features"])

    sample = freeze(
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(labelled_sample(labels, "toxic", limit)), "doc_id")
        .select((F.col("label") == 1).cast("int").alias("label"), "text")
        .mapInArrow(extract, "label int, features array<bigint>")
    )
    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    nothing = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([30.0, 31.0, 32.0]))
    if not n or toxic in (0, n):
        return nothing
    # Features more often in toxic rows than chance allows: the most telling ones by z of the log odds.
    each = sample.select("label", F.explode("features").alias("feature"))
    seen = each.groupBy("feature").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("all")).filter("bad >= 3")
    bad, good = F.col("bad") + 0.5, F.col("all") - F.col("bad") + 0.5
    odds = F.log(bad / (toxic - F.col("bad") + 0.5)) - F.log(good / (n - toxic - F.col("all") + F.col("bad") + 0.5))
    best = seen.select("feature", (odds / F.sqrt(1 / bad + 1 / good)).alias("z")).filter("z > 3").orderBy(F.desc("z"), "feature").limit(FEATURES)
    chosen = np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64))
    if not len(chosen):
        return nothing
    listed = docs.sparkSession.createDataFrame([(int(x),) for x in chosen.view(np.int64)], "feature long")
    numbered = sample.select("label", F.monotonically_increasing_id().alias("row"), "features")
    pairs = numbered.select("row", F.explode("features").alias("feature")).join(F.broadcast(listed), "feature").groupBy("row").agg(
        F.collect_list("feature").alias("found")  # at most FEATURES a row
    )
    got = numbered.select("row", "label").join(pairs, "row", "left").select("label", "found").toArrow().combine_chunks()  # at most SAMPLE rows
    label = got["label"].to_numpy()
    hits = pc.fill_null(pc.list_value_length(got["found"]), 0).to_numpy()
    rows = np.repeat(np.arange(len(label)), hits)
    columns = np.searchsorted(chosen, pc.list_flatten(got["found"]).to_numpy().astype(np.int64).view(np.uint64))
    low, high = np.quantile(hits[label == 1], [1 / 3, 2 / 3])
    grades = np.where(label == 1, 1 + (hits > low) + (hits > high), 0)
    weights, thresholds = fit_ordinal(rows, columns, grades, len(chosen))
    return OrdinalModel(chosen, weights, thresholds)


def severities(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, held_out, score, predicted, severity, grade), a row for each row given.

    score = P(grade >= 1), predicted = 1 if it is 0.5 or more, severity = the expected grade (0 to 3), grade = the
    number of thresholds passed with 0.5 or more. Null texts are empty. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words, there = Words(lower=True, keep_marks=False), model.lookup()
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1), 1 << 20):
                totals = model.totals(high - low, *text_features(words, data, offsets), there)
                chance = model.probabilities(totals)
                columns = [chance[:, 0], (chance[:, 0] >= 0.5).astype(np.int32), chance.sum(1), (chance >= 0.5).sum(1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], *map(pa.array, columns)], ["doc_id", "score", "predicted", "severity", "grade"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        score, f"doc_id {id_type}, score double, predicted int, severity double, grade int"
    )
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "severity", "grade")
