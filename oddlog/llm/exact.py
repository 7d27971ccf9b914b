"""Exact dedup by progressive refinement, in DataFrame functions only.

Texts are compared after each run of ASCII white space became one space. Three looks, each at the rows the last one
could not tell apart: length; length and a hash of the first characters; a hash of the full text. The first two move
two numbers a row; the full text is hashed only where length and opening recur. Groups are never gathered: every look
is a counted aggregate with map-side sums, joined back to the rows, where adaptive execution splits a group of copies
that fills a partition. Texts stay where they were read unless the recurring openings are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddlog.llm.common import WHITE, fresh, text_of
from oddlog.session import broadcast_if_small, freeze

PREFIX_CHARS = 64


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), WHITE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept), one row for each row given.

    `row` is the row's monotonically increasing number in ``docs``, which must come from storage, a checkpoint or a
    local table, so that a second reading numbers alike. A null text is empty, and empty texts are equal. The smallest
    id stays; a null id comes after all others. Of rows that repeat both id and text one is kept, so every group keeps
    exactly one row. Other columns are not looked at. An empty table gives an empty result.
    """
    norm = normalised("text")
    sized = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("length", F.length(norm))
        .withColumn("opening", F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)))
    )
    counted = sized.groupBy("length", "opening").agg(F.count(F.lit(1)).alias("n"))
    lengths = counted.groupBy("length").agg(F.sum("n").alias("n")).filter("n > 1")
    openings = freeze(
        counted.filter("n > 1").join(lengths, "length", "left_semi").select("length", "opening", F.lit(True).alias("recurs"))
    )
    looked = sized.join(broadcast_if_small(openings, openings.count()), ["length", "opening"], "left")
    narrow = freeze(looked.select("row", "doc_id", "length", F.when(F.col("recurs"), F.sha2(norm, 256)).alias("full")))
    groups = freeze(
        narrow.filter("full IS NOT NULL")
        .groupBy("length", "full")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
        .select("length", "full", F.col("least.doc_id").alias("first_id"), F.col("least.row").alias("first_row"), "size")
    )
    alone = F.col("size").isNull()
    return narrow.join(broadcast_if_small(groups, groups.count()), ["length", "full"], "left").select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts (see `exact_groups`)."""
    (row,) = fresh(docs, "_row")
    dropped = exact_groups(docs, id_col, text_col).filter("not kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(dropped, row, "left_anti").drop(row)
