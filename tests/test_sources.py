import json

import random

import pytest
from pyspark.sql import Row, functions as F

from oddlog.sources.sinks import append_metrics, metrics_frame, write_anomalies, write_table, reset
from oddlog.sources.records import ends_inside, split_lines
from oddlog.sources.tables import CsvSource, HitSource, flatten


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('URL,content,n\n/a,"say ""hi""",1\n/b,NA,2\n/c,,3\n/d,null,4\n')
    return str(path)


def test_csv_is_all_text_with_na_words(spark, csv):
    df = CsvSource(spark, csv).load(["URL", "n"])
    assert set(dict(df.dtypes).values()) == {"string"}
    assert [tuple(r) for r in df.orderBy("n").collect()] == [
        ("/a", 'say "hi"', "1"), ("/b", None, "2"), ("/c", None, "3"), ("/d", None, "4")]
    with pytest.raises(ValueError, match="nope"):
        CsvSource(spark, csv).load(["nope"])


def test_csv_lines_in_file_order(spark, tmp_path):
    for part in range(3):
        lines = "\n".join(f"{part * 1000 + i}" for i in range(1000))
        (tmp_path / f"p{part}.csv").write_text("n\n" + lines + "\n")
    for size in ("128m", "200"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df, n = CsvSource(spark, str(tmp_path)).load_in_order()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert n == 3000
        assert all(int(r.n) == r.row_id for r in df.collect())


def test_cache_reload_and_replace(spark, csv):
    source = CsvSource(spark, csv)
    first = source.get_df()
    assert source.get_df() is first
    assert source.get_df(force_reload=True) is not first
    other = spark.range(2)
    assert source.set_df(other).count() == 2


def record(number, kind, port, day, name=None, tags=None):
    source = {"net": {"port": port, "kind": kind}, "seen": f"2031-02-{day:02d}T08:00:00.000Z"}
    if name is not None:
        source["net"]["name"] = name
    if tags is not None:
        source["tags"] = tags
    return {"_id": str(number), "_index": "own-7", "_source": source}


HITS = [
    record(1, "door", 22, 3, "left door opened", ["x", "y"]),
    record(2, "door", 80, 5, "left door closed slowly"),
    record(3, "door", 443, 9),
    record(4, "lamp", 80, 5, "lamp on"),
    record(5, "door", 22, 14, "right door opened", ["z"]),
]
QUERY = {
    "_source": ["net.kind", "net.name"],
    "query": {"bool": {
        "filter": [{"term": {"net.kind": "door"}}, {"range": {"seen": {"gte": "2031-02-03T00:00:00.000Z", "lte": "2031-02-10T00:00:00.000Z"}}}],
        "must_not": [{"query_string": {"fields": ["net.name"], "query": "left door closed slowly"}}],
    }},
}


@pytest.fixture
def hits(tmp_path):
    path = tmp_path / "hits.json"
    path.write_text("\n".join(map(json.dumps, HITS)))
    return str(path)


@pytest.mark.parametrize("keywords", [(), ("net.name",)])
def test_hits_flatten_filter_project(spark, hits, keywords):
    df = HitSource(spark, hits, json.dumps(QUERY), keywords=keywords, partitions=4).load(["net.kind"])
    assert df.columns == ["net.kind", "net.name", "_id", "_index"]
    assert sorted(r["_id"] for r in df.collect()) == (["1", "3"] if keywords else ["3"])
    assert df.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("clause, want", [
    ({"term": {"net.kind": "lamp"}}, "4"),
    ({"term": {"net.port": "443"}}, "3"),
    ({"term": {"tags": "y"}}, "1"),
    ({"term": {"nowhere": "x"}}, ""),
    ({"range": {"nowhere": {"gte": 3}}}, ""),
    ({"range": {"net.port": {"gt": 22, "lt": 443}}}, "24"),
    ({"bool": {"must_not": {"term": {"nowhere": "x"}}}}, "12345"),
    ({"bool": {"filter": {"term": {"net.kind": "door"}}, "must_not": [{"range": {"net.port": {"gte": 100}}}]}}, "125"),
    ({"query_string": {"query": "Lamp opened", "fields": ["net.name", "nowhere"]}}, "145"),
])
def test_hit_clauses(spark, hits, clause, want):
    found = HitSource(spark, hits, {"query": clause}).load()
    assert "".join(sorted(r["_id"] for r in found.collect())) == want


@pytest.mark.parametrize("where, want", [
    ("`net.port` IN (22, 443)", "135"), ("`net.kind` LIKE 'do%' AND `net.name` IS NULL", "3"), (lambda: F.col("`net.port`") > 100, "3"), (None, "12345"),
])
def test_hits_by_a_spark_condition(spark, hits, where, want):
    assert "".join(sorted(r["_id"] for r in HitSource(spark, hits, where=where() if callable(where) else where).load().collect())) == want


@pytest.mark.parametrize("clause", [{"fuzzy": {"net.kind": "dor"}}, {"bool": {"should": []}}, {"match": {"net.name": "a"}}, {}])
def test_unknown_clauses_are_refused(spark, hits, clause):
    with pytest.raises(ValueError):
        HitSource(spark, hits, {"query": clause}).load()


def test_csv_cells_with_line_breaks_and_blanks(spark, tmp_path):
    cells = ["a\nb", ' lead "q" ', "x;y\n\n", "trail  ", "\\n", None, ","]
    df = spark.createDataFrame([(str(k), c) for k, c in enumerate(cells)], "id string, cell string").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    back, n = CsvSource(spark, write_table(df, str(tmp_path / "t")), sep=";").load_in_order()
    assert n == len(cells) and {r.id: r.cell for r in back.collect()} == {str(k): c for k, c in enumerate(cells)}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_hits_cap_lists_and_missing(spark, hits):
    df = HitSource(spark, hits, max_docs=2).load()
    assert sorted(r["_id"] for r in df.collect()) == ["1", "2"]
    assert dict(df.dtypes)["tags"] == "array<string>"
    with pytest.raises(ValueError):
        HitSource(spark, hits).load(["nope"])
    none = {"query": {"bool": {"filter": {"term": {"net.kind": "none"}}}}}
    assert HitSource(spark, hits, none).load(["nope"]).count() == 0


def test_flatten_names(spark):
    df = spark.createDataFrame([Row(a=Row(b=Row(c=1)), d=[1])])
    assert flatten(df).columns == ["a.b.c", "d"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a;b", ["x"]), (1, "c", []), (2, None, None)], "row_id long, msg string, tags array<string>")
    out = str(tmp_path / "t")
    write_table(rows, out)
    back = spark.read.csv(out, sep=";", header=True).orderBy("row_id").collect()
    assert [(r.row_id, r.msg) for r in back] == [("0", "a;b"), ("1", "c"), ("2", None)]
    flags = spark.createDataFrame([(0, "s", "x" * 400), (1, "s", "t2"), (0, "s", "t2")], "row_id long, strategy string, task string")
    target = str(tmp_path / "anomalies")
    write_anomalies(rows, flags, target)
    back = spark.read.csv(target, sep=";", header=True)
    assert sorted((r.msg, len(r.task)) for r in back.collect()) == [("a;b", 2), ("a;b", 400), ("c", 2)]
    reset(spark, target, None)
    assert not (tmp_path / "anomalies").exists()


def test_metrics_rows_share_one_header(spark, tmp_path):
    path = str(tmp_path / "m")
    append_metrics(spark, [{"name": "a", "strategy": "s", "n_samples": 3, "confusion_matrix": {"true_negatives": 2}}], path)
    append_metrics(spark, [{"name": "b", "strategy": "s", "n_models": 4}], path)
    back = {r.name: r for r in spark.read.csv(path, sep=";", header=True).collect()}
    assert back["a"].confusion_matrix_true_negatives == "2" and back["a"].n_models is None
    assert back["b"].n_models == "4"
    with pytest.raises(ValueError):
        metrics_frame(spark, [{"other": 1}])


def _odd_csv(path, rows, seed, ending="\n", lead=""):
    """Records with line breaks, doubled quotes, separators and stray quotes; the cells as they should come back."""
    rng = random.Random(seed)
    bits = ["plain", "a b", "x,y", 'say "hi"', "two\nlines", "\n\n", "end\n", '"', '","', "q" * 400, "\n" * 90, "deep\n" * 60]
    want, out = [], [f"{lead}id,text,more"]
    for k in range(rows):
        cells = [str(k), rng.choice(bits), rng.choice(bits)]
        want.append(cells)
        out.append(",".join(c if c.isalnum() else '"' + c.replace('"', '""') + '"' for c in cells))
        if rng.random() < 0.1:
            out.append("")  # a blank line is no record
    path.write_text(ending.join(out) + ending)
    return want


@pytest.mark.parametrize("size", ["40", "333", "5k", "128m"])
def test_one_csv_file_in_many_tasks(spark, tmp_path, size):
    want = _odd_csv(tmp_path / "one.csv", 300, 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df, n = CsvSource(spark, str(tmp_path / "one.csv")).load_in_order()
        tasks = split_lines(spark, str(tmp_path / "one.csv")).rdd.getNumPartitions()
        got = [[r.id, r.text, r.more] for r in df.orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks >= 8 or size == "128m"
    assert n == 300 and got == want


def test_many_csv_files_and_crossing_headers(spark, tmp_path):
    want = []
    for k in range(3):
        want += _odd_csv(tmp_path / f"f{k}.csv", 40, k, "\r\n" if k == 1 else "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        df, _ = CsvSource(spark, str(tmp_path)).load_in_order()
        assert [[r.id, r.text, r.more] for r in df.orderBy("row_id").collect()] == want
        head = tmp_path / "head.csv"
        head.write_text('"a\n' + "x" * 200 + '",b\n1,2\n3,4\n')
        df = CsvSource(spark, str(head)).load()
        assert df.columns == ["a\n" + "x" * 200, "b"] and sorted(tuple(r) for r in df.collect()) == [("1", "2"), ("3", "4")]
        (tmp_path / "none.csv").write_text("a,b\n")
        assert CsvSource(spark, str(tmp_path / "none.csv")).load().count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stray_quotes_open_no_cell():
    assert not ends_inside('5" disk, 3" disk', False, ",")
    assert ends_inside('5,"open', False, ",") and not ends_inside('shut",5', True, ",")
    assert ends_inside('a""b', True, ",") and not ends_inside('"a""","b"', False, ",") and not ends_inside("", False, ",")
