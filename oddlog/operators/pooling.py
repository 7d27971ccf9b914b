"""Mean token vectors per document."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from oddlog.functions.text import char_ngrams
from oddlog.operators.means import vector_mean
from oddlog.session import freeze

# Token tables up to this many bytes travel to the tasks.
SHIPPED_BYTES = 64 << 20


# Texts that one task of a training run takes.
TRAIN_ROWS = 50_000


def train_token_vectors(df: DataFrame, tokens: str = "tokens", size: int = 64, seed: int = 7, min_count: int = 1) -> DataFrame:
    """Skip-gram vectors ``(token, vector)`` trained on the column itself.

    Tasks grow with the rows, and their vectors are averaged. Rare tokens of a
    large column can be left out with ``min_count``: the mean of their n-grams
    stands for them.
    """
    tasks = -(-df.count() // TRAIN_ROWS) or 1
    model = Word2Vec(
        vectorSize=size, seed=seed, minCount=min_count, numPartitions=tasks, inputCol=tokens, outputCol="_v"
    ).fit(df)
    return model.getVectors().select(F.col("word").alias("token"), "vector")


def _grams(token: Column, low: int, high: int) -> Column:
    return char_ngrams(F.concat(F.lit("<"), token, F.lit(">")), low, high, lowercase=False)


def gram_vectors(vectors: DataFrame, size: int, low: int = 3, high: int = 6) -> DataFrame:
    """``(gram, vector)``: mean vector of the known tokens that contain a gram."""
    grams = vectors.select(
        F.explode(F.array_distinct(_grams(F.col("token"), low, high))).alias("gram"), vector_to_array("vector").alias("vector")
    )
    return vector_mean(grams, ["gram"], "vector", size)


def with_unseen(tokens: DataFrame, vectors: DataFrame, grams: DataFrame, size: int, low: int = 3, high: int = 6) -> DataFrame:
    """Vectors for all of ``tokens``: known ones, else the mean of their grams."""
    known = tokens.select("token").distinct().join(vectors, "token", "left").withColumn("known", F.col("vector").isNotNull())
    missing = known.filter(~F.col("known")).select("token", F.explode(F.array_distinct(_grams(F.col("token"), low, high))).alias("gram"))
    listed = grams.select("gram", vector_to_array("vector").alias("vector"))
    built = vector_mean(missing.join(listed, "gram"), ["token"], "vector", size)
    return known.filter("known").select("token", "vector").unionByName(built)


def _split(lines: DataFrame, vectors: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """The vectors of the most frequent tokens of ``lines``, at most ``bound`` unless tokens repeat, and the others found."""
    counts = lines.groupBy("token").agg(F.count(F.lit(1)).alias("_c"))
    ranked = freeze(counts.join(vectors, "token"))
    # Few counts differ, however many tokens there are.
    sizes = ranked.groupBy("_c").agg(F.count(F.lit(1)).alias("n"))
    running = sizes.withColumn("n", F.sum("n").over(Window.orderBy(F.desc("_c"))))
    least = running.filter(F.col("n") <= bound).agg(F.min("_c")).first()[0]
    often = F.lit(False) if least is None else F.col("_c") >= least
    return ranked.filter(often).drop("_c"), ranked.filter(~often).drop("_c")


def pool(
    df: DataFrame, vectors: DataFrame, size: int, tokens: str = "tokens", key: str = "row_id",
    out: str = "features", vector_rows: int | None = None,
) -> DataFrame:
    """Mean vector of the tokens found; a row without any gets zeros.

    A small vector table travels to the texts, and a row's tokens are summed
    where they are. So do the most frequent tokens of a large one; only the
    others are met in a join.
    """
    vector_rows = vectors.count() if vector_rows is None else vector_rows
    vectors = vectors.select("token", vector_to_array("vector").alias("vector"))
    lines = df.select(key, F.explode(tokens).alias("token"))
    fit = SHIPPED_BYTES // (8 * size + 48)
    if vector_rows <= fit:
        met = lines.join(F.broadcast(vectors), "token")
    else:
        often, rest = _split(lines, vectors, fit)
        rare = lines.join(F.broadcast(often.select("token")), "token", "left_anti")
        met = lines.join(F.broadcast(often), "token").unionByName(rare.join(rest, "token"))
    mean = vector_mean(met, [key], "vector", size, out="_m")
    mean = mean.select(key, vector_to_array("_m").alias("_m"))
    zeros = F.array_repeat(F.lit(0.0), size)
    filled = array_to_vector(F.coalesce("_m", zeros))
    return df.drop(out).join(mean, key, "left").withColumn(out, filled).drop("_m")
