"""Names usable in job files: column steps and detectors, open to additions.

A column step is ``fn(df, column, resources, **params) -> df``: it replaces
``column`` of a frame that also holds ``row_id``. Text steps see a string
column, vector steps a vector column. Bodies may use ``pandas_udf`` or
``mapInPandas``. A detector is a class with ``fit(rows, shared)``.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from oddlog.detectors import ECOD, KNN, LOF, LUNAR, Hierarchy, IForest, Reconstruction
from oddlog.detectors.thresholds import THRESHOLDS
from oddlog.functions import text
from oddlog.functions.ratios import RATIO_NAMES, load_words, ratio_struct, with_meaning
from oddlog.functions.rows import finite_vector
from oddlog.operators import pooling, vocabulary as vocab
from oddlog.operators.autoencoder import fit_autoencoder
from oddlog.operators.order import with_position
from oddlog.operators.reduce import fit_pca, fit_svd
from oddlog.operators.scaling import fit_minmax
from oddlog.session import hold
from oddlog.operators.tfidf import idf_value, tfidf_vectors


def _count_vectorizer(
    df: DataFrame, column: str, resources: dict, analyzer="word", token_pattern=None, lowercase=True,
    ngram_range=(1, 1), max_features=None, min_df=1, max_df=1.0, vocabulary=None,
    shipped_terms=vocab.SHIPPED_TERMS,
) -> DataFrame:
    """Vocabularies of more than ``shipped_terms`` stay a table; the vectors are the same."""
    tokens = text.terms(F.col(column), analyzer, token_pattern, lowercase, tuple(ngram_range))
    termed = df.withColumn("_t", tokens)
    if vocabulary is not None:
        return vocab.count_vectors(termed.drop(column), list(vocabulary), "_t", column).drop("_t")
    cache = resources.setdefault("_vocabularies", {})
    key = (column, analyzer, token_pattern, lowercase, tuple(ngram_range), max_features, min_df, max_df, shipped_terms)
    if key not in cache:
        kept = hold(vocab.vocabulary(termed, "_t", max_features, min_df, max_df))
        size = kept.count()
        if size == 0:
            raise ValueError(f"no terms left for {column!r}: empty texts, or min_df and max_df too strict")
        small = size <= shipped_terms
        cache[key] = (sorted(r.term for r in kept.select("term").collect()) if small else kept, size)
        if small:
            kept.unpersist()
    terms, size = cache[key]
    if isinstance(terms, list):
        return vocab.count_vectors(termed.drop(column), terms, "_t", column).drop("_t")
    numbered, _ = with_position(terms.select("term"), ["term"], "idx")
    counts = vocab.count_long(termed, numbered.withColumn("idx", F.col("idx").cast("int")), size, "_t")
    long = counts.withColumnRenamed("tf", "value")
    vectors = vocab.vectors_from_long(df.select("row_id"), long, size, out=column)
    return df.drop(column).join(vectors, "row_id")


def _hashing(df: DataFrame, column: str, resources: dict, analyzer="word", token_pattern=None, lowercase=True,
             ngram_range=(1, 1), n_features=1 << 18) -> DataFrame:
    tokens = text.terms(F.col(column), analyzer, token_pattern, lowercase, tuple(ngram_range))
    return vocab.hashed_counts(df.withColumn("_t", tokens).drop(column), "_t", n_features, column).drop("_t")


def _tfidf(df: DataFrame, column: str, resources: dict, norm="l2", use_idf=True, smooth_idf=True,
           sublinear_tf=False) -> DataFrame:
    weights = None
    if use_idf:
        found = df.agg(F.count(F.lit(1)).alias("n"), Summarizer.numNonZeros(F.col(column)).alias("df")).first()
        # A term of no row has no weight to give.
        weights = [idf_value(d, found.n, smooth_idf) if d or smooth_idf else 1.0 for d in found.df.toArray()]
    return tfidf_vectors(df, weights, norm, sublinear_tf, column)


def _ratios(df: DataFrame, column: str, resources: dict, lowercase=False, meaning_dic_path=None) -> DataFrame:
    words = resources.get(meaning_dic_path)
    if words is None and meaning_dic_path and os.path.exists(meaning_dic_path):
        words = load_words(df.sparkSession, meaning_dic_path)
    made = with_meaning(df, F.col(column), words, "row_id", lowercase, "_meaning")
    made = made.withColumn("_r", ratio_struct(F.col(column), lowercase))
    listed = F.array(*[F.col("_r")[n].cast("float") for n in RATIO_NAMES[:-1]], F.col("_meaning").cast("float"))
    return made.withColumn(column, array_to_vector(listed.cast("array<double>"))).drop("_meaning", "_r")


def _pool(df: DataFrame, column: str, resources: dict, model=None, pattern=r"[\w.\W]", size=64) -> DataFrame:
    """Token vectors come from ``resources[model]``; else the column trains them."""
    tokens = text.word_tokens(F.col(column), pattern, lowercase=False)
    termed = df.withColumn("_t", tokens)
    vectors = resources.get(model)
    if vectors is None:
        vectors = pooling.train_token_vectors(termed, "_t", size)
    width = vectors.first()["vector"].size
    used = termed.select(F.explode("_t").alias("token"))
    total = hold(pooling.with_unseen(used, vectors, pooling.gram_vectors(vectors, width), width))
    return pooling.pool(termed, total, width, "_t", out=column).drop("_t")


def _autoencoder(df: DataFrame, column: str, resources: dict, hidden_neurons=None, epochs=20, lr=0.03, linear=False, **_) -> DataFrame:
    """Encoding of the last hidden width: by a network, trained one full-batch step an epoch, or, if `linear`, by
    principal components. A batch size has no meaning here."""
    widths = list(hidden_neurons or [128, 64])
    cleaned = df.withColumn(column, finite_vector(F.col(column)))
    if linear:
        return fit_pca(cleaned, widths[-1], column).transform(cleaned, column)
    return fit_autoencoder(cleaned, widths, epochs, lr, features=column).transform(cleaned, column)


def _minmax(df: DataFrame, column: str, resources: dict) -> DataFrame:
    return fit_minmax(df, column).transform(df, column)


def _svd(df: DataFrame, column: str, resources: dict, n_components=2, **_) -> DataFrame:
    return fit_svd(df, n_components, column).transform(df, column)


def _nan_to_num(df: DataFrame, column: str, resources: dict) -> DataFrame:
    return df.withColumn(column, finite_vector(F.col(column)))


def _wrap(df: DataFrame, column: str, resources: dict) -> DataFrame:
    kind = df.schema[column].dataType
    return df.withColumn(column, F.array(column)) if isinstance(kind, T.StringType) else df


def _same(df: DataFrame, column: str, resources: dict) -> DataFrame:
    """Sparse vectors are read as dense ones wherever that is needed."""
    return df


# Fixed names: job files refer to steps and detectors by these.
FEATURES: dict[str, Callable[..., DataFrame]] = {
    "CountVectorizer": _count_vectorizer,
    "HashingVectorizer": _hashing,
    "TfidfTransformerWrapper": _tfidf,
    "TfidfTransformer": _tfidf,
    "TfidfVectorizer": _tfidf,
    "RatiosWrapper": _ratios,
    "DocumentPoolWrapper": _pool,
    "AutoencoderWrapper": _autoencoder,
    "MinMaxScaler": _minmax,
    "TruncatedSVD": _svd,
    "WrapStringsTransformer": _wrap,
    "DenseTransformer": _same,
    "NanToNumDaskTransformer": _nan_to_num,
    "densify": _same,
    "nan_to_num": _nan_to_num,
}
DETECTORS: dict[str, type] = {
    "IForest": IForest,
    "ECOD": ECOD,
    "KNN": KNN,
    "LOF": LOF,
    "LUNAR": LUNAR,
    "VAE": Reconstruction,
    "AutoEncoder": Reconstruction,
    "HDBSCAN": Hierarchy,
}


def register_feature(name: str, fn: Callable[..., DataFrame]) -> None:
    FEATURES[name] = fn


def register_detector(name: str, cls: type) -> None:
    DETECTORS[name] = cls


def register_threshold(name: str, fn: Callable[[DataFrame], float]) -> None:
    THRESHOLDS[name] = fn


def numeric_vector(df: DataFrame, column: str) -> DataFrame:
    """A numeric column that no step touched is a one-wide vector."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return df.withColumn(column, array_to_vector(F.array(F.col(column).cast("double"))))
    return df
