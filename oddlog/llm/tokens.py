"""Token counts of whole texts by a two-tier lookup; no text or unit of text is ever shuffled.

Texts are cut at single spaces between two other characters. The tokenizer's own pattern always cuts there and puts
the space at the head of what follows, so a text's tokens are those of its units. Tier one is a broadcast table of the
units that are frequent in the corpus (at most `FREQUENT`, counted over every text) with their token counts. Tier two
is a cache in each Python worker: what neither knows is encoded once, in batches, and kept while the cache is below
its bound. Units longer than `LONG` and texts that name a special token go to the library directly.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FREQUENT = 50_000
CACHED = 400_000
LONG = 48
TOP_OF_BATCH = 4_000
_APART = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"\s \s|\s \Z")
_workers: dict = {}


class Counts:
    """Token counts by one tokenizer file; lives as long as its worker process."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.cache: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def text(self, text: str) -> int:
        if any(s in text for s in self.special):
            return self.encode([text])[0]
        units = cut(text)
        known, cache = self.known, self.cache
        found = [known.get(u) for u in units]
        if None not in found:
            return sum(found)
        missed = [u for u, n in zip(units, found) if n is None]
        new = list({u for u in missed if u not in cache})
        counts = dict(zip(new, self.encode(new))) if new else {}
        total = sum(n for n in found if n is not None) + sum(counts[u] if u in counts else cache[u] for u in missed)
        if len(cache) + len(counts) > CACHED:
            cache.clear()
        cache.update((u, n) for u, n in counts.items() if len(u) <= LONG)
        return total


def cut(text: str) -> list[str]:
    """Units of a text, each after the first with the space before it."""
    units = _APART.split(text) if _UNSAFE.search(text) else text.split(" ")
    return [units[0], *[" " + u for u in units[1:]]] if units[0] else [" " + u for u in units[1:]]


def _worker(path: str) -> Counts:
    if path not in _workers:
        _workers[path] = Counts(path)
    return _workers[path]


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    column = batch.column(batch.schema.get_field_index(name))
    for k in range(len(column)):  # one at a time: a batch may hold very long texts
        yield column[k].as_py() or ""


def frequent_units(docs: DataFrame, text_col: str = "text", limit: int = FREQUENT) -> list[str]:
    """At most `limit` units that occur most often over all texts.

    Each batch sends its `TOP_OF_BATCH` most frequent units of those it holds twice or more; they are summed in the
    shuffle. Only the speed of the lookup depends on which units are listed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in _texts(batch, "text"):
                seen.update(cut(text))
                if len(seen) > 4 * CACHED:
                    seen = Counter({u: n for u, n in seen.items() if n > 1})
            top = [(u, n) for u, n in seen.most_common(TOP_OF_BATCH) if n > 1 and len(u) <= LONG]
            if top:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top]), pa.array([n for _, n in top], pa.int64())], ["unit", "n"])

    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "unit string, n bigint")
    rows = found.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(limit).collect()
    return [r.unit for r in rows]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row given, tokens as `path` (a tokenizers .json) has them.

    A null text is empty: 0 bytes, 0 tokens. Special strings inside texts are what the library makes of them by
    default; nothing is added, cut off or padded. Null ids, repeated rows and empty tables pass through; other columns
    are not looked at. The tokenizer file is read where the task runs.
    """
    spark = docs.sparkSession
    units = frequent_units(docs, text_col)
    lengths = dict(zip(units, Counts(path).encode(units))) if units else {}
    table = spark.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _worker(path)
        counts.known = table.value
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in _texts(batch, "text"):
                n_bytes.append(len(text.encode()))
                n_tokens.append(counts.text(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
