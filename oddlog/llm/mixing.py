"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of size s that should fill a share w of a mixture as large as the corpus repeats at the rate w * total / s.
Each document is copied Poisson(rate) times, by inverting the distribution at a uniform number hashed from seed and
id: no random state, so a task that runs again makes the same copies. Sizes are sums with map-side halves; the rate
table has a row a source and is broadcast only below a counted bound.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from oddlog.llm.common import fresh, shuffle_parts, text_of
from oddlog.session import broadcast_if_small, freeze

SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, hashed from the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None, alpha: float, source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """(source, size, rate, steps): size in characters over all rows, steps = P(copies <= 0), P(copies <= 1), ...

    Without `weights` a source's weight is size ** alpha (1 keeps the mixture, 0 makes sources even); with them, a
    source that is not named has weight 0. The steps go 12 standard deviations and 20 beyond the mean; they are added
    in logarithms, so that no rate is too large for them.
    """
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.sum(F.length(text_of(text_col))).cast("double").alias("size")
    )
    sizes = freeze(sizes)
    named = F.create_map(*[F.lit(x) for pair in (weights or {}).items() for x in pair]) if weights else None
    weight = F.coalesce(F.element_at(named, F.coalesce("source", F.lit(""))), F.lit(0.0)) if weights else F.pow("size", F.lit(alpha))
    weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, weight.cast("double")).otherwise(0.0))
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()  # two numbers
    scale = F.lit(total["size"] / total["weight"] if total["weight"] else 0.0)
    rate = F.when(F.col("size") > 0, F.col("weight") / F.col("size") * scale).otherwise(0.0)
    rated = weighed.select("source", "size", rate.alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    start = F.struct(
        (-F.col("rate")).alias("log_p"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("steps")
    )

    def further(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(F.col("rate") / k)
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.array_append(acc["steps"], total).alias("steps"))

    steps = F.aggregate(F.sequence(F.lit(1), last), start, further)["steps"]
    return rated.withColumn("steps", F.when(F.col("rate") > 0, steps).otherwise(F.array(F.lit(1.0))))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, seed: str = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Copies of the rows of ``docs``, shuffled over the whole, with copy_no (from 0) and shuffle_key.

    A null source is a source of its own, and its weight is that of "" where weights are given. Rows of size 0 (null
    and empty texts) have their source's rate, or none if the source holds no text. Rows that repeat an id draw the
    same count. shuffle_key is a hash of seed, id and copy; rows are dealt and sorted by it. Columns of ``docs`` that
    are named copy_no or shuffle_key are replaced. An empty table gives an empty result.
    """
    source, steps, copies = fresh(docs, "_source", "_steps", "_copies")
    rates = freeze(source_rates(docs, weights, alpha, source_col, text_col)).select(
        F.col("source").alias(source), F.col("steps").alias(steps)
    )
    drawn = uniform(F.lit(seed), F.col(f"`{id_col}`"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy_no", "shuffle_key")]
    dealt = (
        docs.join(broadcast_if_small(rates, rates.count()), F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
        .withColumn(copies, F.size(F.filter(F.col(steps), lambda p: p <= drawn)))
        .filter(F.col(copies) > 0)
        .select(*kept, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias("copy_no"))
        .withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), F.col(f"`{id_col}`"), F.col("copy_no"))))
    )
    return dealt.repartition(shuffle_parts(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
