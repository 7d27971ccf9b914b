r"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Words are maximal runs of letters and digits, lower-cased; a set is the distinct 5-word shingles (a shorter text is
one shingle, so an item below five words matches whole texts only). A document contains an item if it has 80 in 100 of the item's shingles or more. Items are partitioned
by powers of two of their set size, and the upper bound u of a partition sets how many of an item's least hash values
are its sketch: u - ceil(0.8 u) + 1. A document that lacks all of them lacks too many shingles, so no pair is missed
however long the document is. Sketch values are looked up among the documents' shingles, and candidates are verified
by counting shared shingles as text.

The sketch table has about a fifth of the benchmark's shingles and is broadcast below a counted bound, else joined by
a shuffle that adaptive execution splits where a passage is in a third of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddlog.llm.common import fresh, text_of
from oddlog.session import broadcast_if_small, freeze

WORDS, SHARE = 5, 80


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, make) -> Column:
    """`make` of each run of WORDS words, of all words if they are fewer, of nothing if there are none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda k: make(F.slice(words, k, WORDS)))
    return F.when(F.size(words) >= WORDS, runs).when(F.size(words) > 0, F.array(make(words))).otherwise(F.slice(F.array(make(words)), 1, 0))


def _text_sets(df: DataFrame, name: str) -> DataFrame:
    """The distinct shingles as text, in place of the text. The words are a column of their own: inside a lambda an
    expression is computed for every element."""
    return df.withColumn("words", words_of("text")).select(
        *[c for c in df.columns if c != "text"], F.array_distinct(shingles(F.col("words"), lambda w: F.concat_ws(" ", w))).alias(name)
    )


def _needed(n: Column, share: int) -> Column:
    return F.ceil(n * share / F.lit(100)).cast("int")


def sketches(items: DataFrame, share: int = SHARE) -> DataFrame:
    """(item_id, key, needed): the sketch of each item with a word, by the bound of its size partition."""
    worded = items.select("item_id", words_of("text").alias("words"))
    hashed = worded.select("item_id", F.array_distinct(shingles(F.col("words"), F.xxhash64)).alias("set")).filter("size(set) > 0")
    size = F.size("set")
    bound = F.pow(F.lit(2), F.floor(F.log2(size)) + 1).cast("int") - 1
    ranked = F.array_sort(F.transform("set", lambda s: F.struct(F.xxhash64(s, F.lit("minhash")).alias("rank"), s.alias("key"))))
    least = F.slice(ranked, 1, bound - _needed(bound, share) + 1)
    return hashed.select("item_id", _needed(size, share).alias("needed"), F.explode(least).alias("least")).select(
        "item_id", "needed", F.col("least.key").alias("key")
    )


def contaminated(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every document that contains an item, pair by pair.

    Null and empty texts contain nothing and are contained in nothing. Rows that repeat a doc_id or item_id give one
    pair, that of the largest containment; null ids are ids. Other columns are not looked at.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    keys = freeze(sketches(items, share))
    found = docs.withColumn("words", words_of("text")).select(
        "doc_id", F.size("words").alias("n_words"), F.explode(shingles(F.col("words"), F.xxhash64)).alias("key")
    )
    # A set of n shingles takes n words at least.
    pairs = freeze(
        found.join(broadcast_if_small(keys, keys.count()), "key").filter("n_words >= needed").select("doc_id", "item_id").distinct()
    )
    doc, item = pairs.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i")), _text_sets(items, "item_set")
    item = item.withColumn("n_item", F.size("item_set")).filter("n_item > 0")
    wanted = broadcast_if_small(doc.select("d").distinct(), doc.count())
    sets = _text_sets(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "text"), "doc_set")
    both = sets.join(broadcast_if_small(doc, doc.count()), F.col("doc_id").eqNullSafe(F.col("d"))).join(
        broadcast_if_small(item, item.count()), F.col("i").eqNullSafe(F.col("item_id"))
    )
    counted = both.select("doc_id", "item_id", "n_item", F.size(F.array_intersect("item_set", "doc_set")).alias("n_shared"))
    # Rows that repeat an id are summed up before anything else looks at the count, so it is counted once.
    most = counted.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    enough = most.filter(F.col("n_shared") * 100 >= F.col("n_item") * share)
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("best"))
    return best.select(
        "doc_id", "item_id", F.col("best.n_shared").cast("long").alias("n_shared"), F.col("best.n_item").cast("long").alias("n_item"),
        (F.col("best.n_shared") / F.col("best.n_item")).alias("containment"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with all their columns.

    Each row goes by its own text, whatever its doc_id. Rows are numbered, so ``docs`` must come from storage, a
    checkpoint or a local table.
    """
    (row,) = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    texts = numbered.select(F.col(row).alias("doc_id"), "text")
    found = freeze(contaminated(texts, items, share).select(F.col("doc_id").alias(row)).distinct())
    return numbered.join(broadcast_if_small(found, found.count()), row, "left_anti").drop(row)
