"""What plans must look like, and that results do not depend on partitioning."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oddlog.operators import nearest as nn, vocabulary as vb  # noqa: E402
from oddlog.plans import catalog  # noqa: E402
from oddlog.session import broadcast_if_small, spread  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["win_sum_sliding", "ecod_urls", "iforest_scores", "vocab_word", "vote_point"])
def test_partitioning_does_not_change_results(spark, name):
    found = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = catalog.QUERIES[name](spark, SF)
            found.append(sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1]


def test_hit_predicates_and_columns_reach_the_scan(spark):
    text = plan(catalog.hit_flatten_filter(spark, SF))
    assert "PushedFilters: [" in text and "EqualTo(event_type,error)" in text
    assert "ReadSchema: struct<event_id" in text and "html" not in text


def test_url_ratios_read_two_columns(spark):
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(catalog.url_ratios(spark, SF))


def test_copies_are_limited_before_the_shuffle(spark):
    rows = nn.unpacked(catalog.embeddings(spark, SF), "row_id", "features", 64).withColumn("is_base", F.lit(True))
    text = plan(nn._distinct(rows, 6, True))
    assert text.index("Final") < text.index("Exchange hashpartitioning", text.index("Final")) < text.index("Partial")


def test_neighbours_meet_in_a_grid_of_cells(spark):
    rows = nn.unpacked(catalog.embeddings(spark, SF), "row_id", "features", 64).withColumn("is_base", F.lit(True))
    vectors = nn._distinct(rows, 6, True)
    n = vectors.count()
    left, right = nn.grid(vectors, 1 << 16, 8)
    cells = right.select("a", "b").distinct().count()
    assert cells == 16  # sqrt(2 * 8 cores) groups a side, however few the rows
    assert left.count() == 4 * n and right.count() == 4 * n
    left, right = nn.grid(vectors, -(-n // 9), 8)
    assert right.select("a", "b").distinct().count() == 81 and right.count() == 9 * n


def test_top_terms_need_one_shuffle(spark):
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"])], "row_id long, tokens array<string>")
    text = plan(vb.vocabulary(docs, max_features=5, n_docs=2))
    assert text.count("Exchange hashpartitioning") == 1 and "TakeOrderedAndProject" in text


def test_only_small_tables_are_spread_or_broadcast(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    wide = spark.range(10, numPartitions=cores + 3)
    assert spread(wide) is wide
    assert broadcast_if_small(wide, 10, 5) is wide and broadcast_if_small(wide, 5, 5) is not wide
