"""Term statistics, pruned vocabularies and count features."""

from __future__ import annotations

from numbers import Integral

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, HashingTF
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F

from oddlog.session import broadcast_if_small

# Vocabularies up to this size travel to the tasks; larger ones stay a table.
SHIPPED_TERMS = 200_000


def term_counts(df: DataFrame, tokens: str = "tokens", key: str = "row_id") -> DataFrame:
    """Long form ``(key, term, tf)`` of a token array column."""
    return (
        df.select(key, F.explode(tokens).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _document_bound(value: float | int, n_docs: int) -> int:
    """Whole numbers are row counts, fractions a share rounded half to even."""
    return int(value) if isinstance(value, Integral) else int(round(value * n_docs))


def vocabulary(
    df: DataFrame,
    tokens: str = "tokens",
    max_features: int | None = None,
    min_df: float | int = 1,
    max_df: float | int = 1.0,
    n_docs: int | None = None,
) -> DataFrame:
    """Kept terms ``(term, tf, df)``; a document without terms still counts.

    With ``max_features`` the most frequent terms win, ties by term.
    """
    n_docs = df.count() if n_docs is None else n_docs
    least, most = _document_bound(min_df, n_docs), _document_bound(max_df, n_docs)
    if most < least:
        raise ValueError("max_df allows fewer documents than min_df")
    # A row holds its whole text, so its distinct terms need no shuffle: every
    # token counts once for tf, every distinct one once for df.
    marked = F.concat(
        F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
    )
    stats = (
        df.select(F.explode(marked).alias("m"))
        .groupBy(F.col("m.term").alias("term"))
        .agg(F.sum("m.tf").alias("tf"), F.sum("m.df").alias("df"))
        .filter(F.col("df").between(least, most))
    )
    if max_features is not None:
        stats = stats.orderBy(F.desc("tf"), "term").limit(int(max_features))
    return stats


def indexed(vocab: DataFrame) -> DataFrame:
    """Alphabetical index ``idx`` for a vocabulary bounded by ``max_features``."""
    terms = F.array_sort(F.collect_list(F.struct("term", "tf", "df")))
    return (
        vocab.agg(terms.alias("all"))
        .select(F.posexplode("all").alias("idx", "t"))
        .select("idx", "t.term", "t.tf", "t.df")
    )


def count_vectors(df: DataFrame, terms: list[str], tokens: str = "tokens", out: str = "features") -> DataFrame:
    """Sparse count vectors against a fixed, ordered vocabulary; no shuffle."""
    model = CountVectorizerModel.from_vocabulary(list(terms), inputCol=tokens, outputCol=out)
    return model.transform(df)


def count_long(df: DataFrame, vocab: DataFrame, vocab_rows: int, tokens: str = "tokens", key: str = "row_id") -> DataFrame:
    """Counts ``(key, idx, term, tf)`` of vocabulary terms, for any vocabulary size."""
    counts = term_counts(df, tokens, key)
    return counts.join(broadcast_if_small(vocab.select("term", "idx"), vocab_rows), "term")


def hashed_counts(df: DataFrame, tokens: str = "tokens", size: int = 1 << 18, out: str = "features") -> DataFrame:
    """Counts in ``size`` hash buckets; needs no vocabulary and no shuffle."""
    return HashingTF(inputCol=tokens, outputCol=out, numFeatures=size).transform(df)


_SPARSE = pa.struct([
    pa.field("type", pa.int8(), False), pa.field("size", pa.int32()),
    pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))),
    pa.field("values", pa.list_(pa.field("element", pa.float64(), False))),
])


def vectors_from_long(
    rows: DataFrame, long: DataFrame, width: int, key: str = "row_id", out: str = "features"
) -> DataFrame:
    """Sparse vectors from ``(key, idx, value)`` when the vocabulary stays a table; batches are built whole."""

    def sparse(places: pa.Array, values: pa.Array) -> pa.Array:
        kind, size = np.zeros(len(places), "int8"), np.full(len(places), width, "int32")
        columns = [pa.array(kind), pa.array(size), places.cast(_SPARSE[2].type), values.cast(_SPARSE[3].type)]
        return pa.StructArray.from_arrays(columns, fields=list(_SPARSE))

    vector = F.arrow_udf(sparse, VectorUDT())
    entries = F.sort_array(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value"))))
    listed = long.groupBy(key).agg(entries.alias("_e"))
    none = F.array().cast("array<struct<idx:int,value:double>>")
    filled = rows.select(key).join(listed, key, "left").withColumn("_e", F.coalesce("_e", none))
    return filled.select(key, vector(F.col("_e.idx"), F.col("_e.value")).alias(out))
