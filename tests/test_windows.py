"""Pane windows and entity positions by brute force, and the rows they move."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from oddlog.operators import windows as wd
from oddlog.operators.order import with_entity_position


@pytest.mark.parametrize("size, overlap", [(4, 0), (4, 3), (6, 2), (10, 5), (5, 3), (1, 0), (7, 6), (12, 4)])
def test_sliding_against_brute_force(spark, size, overlap):
    random.seed(size)
    values = [random.choice([None, float(random.randint(-9, 9))]) for _ in range(53)]
    y = [random.choice([0, 0, 0, 1]) for _ in values]
    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("features", VectorUDT()), T.StructField("y", T.IntegerType())])
    df = spark.createDataFrame([(k, v, Vectors.dense([k, 1.0]), t) for k, (v, t) in enumerate(zip(values, y))], schema)
    step = size - overlap
    spans = [(w, w * step, w * step + size) for w in range(0, 1 + (53 - size) // step)]
    got = {r.win_id: r.v for r in wd.sliding_values(df.repartition(4), size, overlap, ["v"]).collect()}
    sums = {r.win_id: r.v for r in wd.sliding_values(df, size, overlap, ["v"], "sum").collect()}
    labels = {r.win_id: r.y for r in wd.sliding_labels(df, size, overlap).collect()}
    means = {r.win_id: list(r.features) for r in wd.sliding_features(df, size, overlap).collect()}
    assert set(got) == set(sums) == set(labels) == set(means) == {w for w, _, _ in spans}
    for w, a, b in spans:
        known = [v for v in values[a:b] if v is not None]
        assert got[w] == (pytest.approx(np.mean(known)) if known else None)
        assert sums[w] == (pytest.approx(sum(known)) if known else None)
        assert labels[w] == max(y[a:b]) and means[w] == pytest.approx([np.mean(range(a, b)), 1.0])


def test_no_row_moves_more_than_twice(spark):
    panes = spark.range(5000).select(F.col("id").alias("pane"), F.array(F.lit(1.0)).alias("part"))
    assert wd._halves(panes, [], 80, 1, False).count() <= 2 * 5000


def test_fewer_rows_than_a_window(spark):
    df = spark.range(3).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    assert wd.sliding_values(df, 5, 2, ["v"]).count() == 0 and wd.sliding_values(df.limit(0), 5, 2, ["v"]).count() == 0


def test_a_hot_entity_spans_tasks(spark):
    rows = [("hot", k) for k in range(4000)] + [(f"e{k % 40}", k) for k in range(400)] + [(None, k) for k in range(30)]
    random.seed(1)
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "who string, at int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions of full size
    try:
        placed = with_entity_position(df, "who", ["at"])
        tasks = placed.filter("who = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(r[0], r[1]): n for who in {r[0] for r in rows} for n, r in enumerate(sorted((r for r in rows if r[0] == who), key=lambda r: r[1]))}
    assert {(r.who, r.at): r.pos for r in placed.collect()} == want
    assert len(tasks) > 2 and max(t["count"] for t in tasks) < 2000
    spans = wd.sliding_values(placed.withColumn("v", F.col("pos").cast("double")), 10, 5, ["v"], by=["who"]).collect()
    found = {(r.who, r.win_id): r.v for r in spans}
    assert found == {(who, w): w * 5 + 4.5 for who, n in {None: 30, "hot": 4000, **{f"e{k}": 10 for k in range(40)}}.items() for w in range(1 + (n - 10) // 5)}


def test_no_rows_no_positions(spark):
    assert with_entity_position(spark.createDataFrame([], "who string, at int"), "who", ["at"]).count() == 0
