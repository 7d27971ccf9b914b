"""Documents to a training mixture: five stages, each on all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. Stages
read their input twice or more, so it must be stored: a Parquet file, or a checkpoint as in `run`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oddlog.llm import decontaminate, exact, mixing, ngram_join, quality
from oddlog.llm.common import fresh, table
from oddlog.session import broadcast_if_small, freeze

# Near copies share 80 of 100 of their runs of five words; the three words and 90 of 100 of op3 are that query's own.
NEAR = {"n": 5, "num": 80, "den": 100}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the rule ensemble scores 0.5 or more; it learns from all documents with labels, not from what is left."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return quality.with_score(docs, model, out=score).filter(F.col(score) >= 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links join, the one of the least doc_id; null ids come last, and of equal ids the first row stays."""
    (row,) = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    classes = freeze(ngram_join.near_classes(numbered.select(row, "text"), **NEAR, id_col=row).select(F.col("doc_id").alias("_at"), "component_id"))
    several = freeze(classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    member = freeze(classes.join(broadcast_if_small(several, several.count()), "component_id"))
    ids = numbered.select(F.col(row).alias("_at"), F.col("doc_id").alias("_id"))
    named = freeze(ids.join(broadcast_if_small(member, member.count()), "_at"))
    first = freeze(named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_at")).alias("least")))
    gone = freeze(named.join(broadcast_if_small(first, first.count()), "component_id").filter("_at <> least._at").select(F.col("_at").alias(row)))
    return numbered.join(broadcast_if_small(gone, gone.count()), row, "left_anti").drop(row)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the rest in shuffled order, sources weighed by size ** 0.5."""
    return mixing.mix(docs, alpha=0.5)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

# The fitted classifier is beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each on the checkpoint of the one before."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
