import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from oddlog.detectors.thresholds import iqr, mad, zscore
from oddlog.operators import evaluate as ev, pooling, vocabulary as vb, windows as wd
from oddlog.operators.components import components
from oddlog.operators.ecdf import tail_counts
from oddlog.operators.means import vector_mean
from oddlog.operators.order import with_position
from oddlog.operators.quantile import quantiles
from oddlog.operators.reduce import fit_pca, fit_svd
from oddlog.operators.scaling import fit_minmax
from oddlog.operators.tfidf import tfidf_long, tfidf_vectors, idf_value

DOCS = [["b", "a", "b"], ["a"], [], ["c", "a", "d"]]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "row_id long, tokens array<string>")


def test_positions_follow_the_keys(spark):
    values = np.random.default_rng(0).permutation(1000)
    df = spark.createDataFrame([(int(v) // 500, int(v)) for v in values], "g int, v int").repartition(5)
    placed, n = with_position(df, ["g", "v"])
    assert n == 1000
    assert all(r.pos == r.v for r in placed.collect())


@pytest.mark.parametrize("n,size,overlap", [(10, 4, 0), (10, 4, 3), (10, 10, 0), (7, 3, 1), (3, 4, 0), (160, 80, 79)])
def test_windows(spark, n, size, overlap):
    rows = spark.range(n).withColumnRenamed("id", "pos").withColumn("x", F.col("pos") * 1.5)
    spans = [range(s, s + size) for s in range(0, n - size + 1, size - overlap)] if n >= size else []
    assert wd.window_count(n, size, overlap) == len(spans)
    if not spans:
        return
    placed = wd.assign_windows(rows, n, size, overlap)
    got = {r.win_id: r.x for r in wd.window_values(placed, ["x"]).collect()}
    assert got == pytest.approx({i: np.mean([p * 1.5 for p in s]) for i, s in enumerate(spans)})
    flagged = spark.createDataFrame([(i, -1 if i % 2 else 1) for i in range(len(spans))], "win_id long, label int")
    flags = {r.pos: r.row_flag for r in wd.expand_to_rows(rows, flagged, size, overlap).collect()}
    hit = {p for i, s in enumerate(spans) if i % 2 for p in s}
    assert flags == {p: (-1 if p in hit else 0) for p in range(n)}


def test_window_edges(spark):
    with pytest.raises(ValueError):
        wd.window_count(10, 4, 4)
    rows = spark.range(4).select(F.col("id").alias("pos"), F.col("id").cast("int").alias("y"))
    placed = wd.assign_windows(rows.withColumn("y", (F.col("y") == 1).cast("int")), 4, 2)
    assert dict(wd.window_labels(placed).collect()) == {0: 1, 1: 0}


def test_vocabulary_rules(spark, docs):
    def kept(**kw):
        return sorted((r.term, r.tf, r.df) for r in vb.vocabulary(docs, **kw).collect())

    assert kept() == [("a", 3, 3), ("b", 2, 1), ("c", 1, 1), ("d", 1, 1)]
    assert kept(max_features=3) == [("a", 3, 3), ("b", 2, 1), ("c", 1, 1)]
    assert kept(max_df=0.5) == [("b", 2, 1), ("c", 1, 1), ("d", 1, 1)]
    assert kept(min_df=2) == [("a", 3, 3)]
    assert kept(min_df=0.625) == [("a", 3, 3)]  # 2.5 rows round to the even 2
    with pytest.raises(ValueError):
        vb.vocabulary(docs, max_df=1, min_df=2)
    rows = vb.indexed(vb.vocabulary(docs, max_features=3)).collect()
    assert [(r.idx, r.term) for r in rows] == [(0, "a"), (1, "b"), (2, "c")]


@pytest.mark.parametrize("norm", ["none", "l1", "l2"])
@pytest.mark.parametrize("smooth,sublinear", [(True, False), (False, True)])
def test_tfidf_forms_agree(spark, docs, norm, smooth, sublinear):
    terms, n = ["a", "b", "c", "d"], len(DOCS)
    df = Counter(t for d in DOCS for t in set(d))
    idf = [math.log((n + smooth) / (df[t] + smooth)) + 1 for t in terms]
    assert [idf_value(df[t], n, smooth) for t in terms] == pytest.approx(idf)
    want = []
    for doc in DOCS:
        c = Counter(doc)
        row = [((1 + math.log(c[t])) if sublinear and c[t] else c[t]) * w for t, w in zip(terms, idf)]
        size = {"none": 1, "l1": sum(row), "l2": math.sqrt(sum(x * x for x in row))}[norm] or 1
        want.append([x / size for x in row])
    vectors = tfidf_vectors(vb.count_vectors(docs, terms), idf, norm, sublinear)
    got = dict(vectors.select("row_id", vector_to_array("features")).collect())
    assert [got[i] for i in range(n)] == [pytest.approx(w) for w in want]
    long = tfidf_long(vb.term_counts(docs), vb.vocabulary(docs), n, norm, True, smooth, sublinear)
    assert {(r.row_id, r.term): r.value for r in long.collect()} == pytest.approx(
        {(i, t): v for i, row in enumerate(want) for t, v in zip(terms, row) if v}
    )


def test_vectors_from_a_vocabulary_table(spark, docs):
    vocab = vb.indexed(vb.vocabulary(docs))
    long = vb.count_long(docs, vocab, 4).withColumnRenamed("tf", "value")
    got = dict(vb.vectors_from_long(docs, long, 4).select("row_id", vector_to_array("features")).collect())
    want = dict(vb.count_vectors(docs, ["a", "b", "c", "d"]).select("row_id", vector_to_array("features")).collect())
    assert got == want


@pytest.mark.parametrize("rows", [[[0, 3, 2], [4, 3, 0]], [[1, 3, -2], [4, 3, 0], [2, 3, 5]]])
def test_minmax(spark, rows):
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(rows)], ["row_id", "features"])
    got = dict(fit_minmax(df).transform(df).select("row_id", vector_to_array("features")).collect())
    x = np.array(rows, float)
    span = np.ptp(x, axis=0)
    want = np.where(span > 0, (x - x.min(0)) / np.where(span > 0, span, 1), 0)
    if x.min(0)[1] == 3 and not x.min(0)[0]:
        want[:, 1] = 0
    assert [got[i] for i in range(len(rows))] == [pytest.approx(w.tolist()) for w in want]


def test_linear_encoders(spark):
    x = np.random.default_rng(1).normal(size=(60, 4)) @ np.diag([5, 2, 1, 0.1])
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["row_id", "features"])
    for fit, mean in ((fit_pca, x.mean(0)), (fit_svd, np.zeros(4))):
        got = dict(fit(df, 2).transform(df).select("row_id", vector_to_array("features")).collect())
        v = np.linalg.svd(x - mean, full_matrices=False)[2][:2].T
        assert np.abs([got[i] for i in range(60)]) == pytest.approx(np.abs((x - mean) @ v), abs=1e-6)


@pytest.mark.parametrize("shipped", [0, 1 << 20])
def test_pooling(spark, shipped, monkeypatch):
    monkeypatch.setattr(pooling, "SHIPPED_BYTES", shipped)
    vectors = spark.createDataFrame([("aa", Vectors.dense([1.0, 0.0])), ("bb", Vectors.dense([0.0, 2.0]))], ["token", "vector"])
    docs = spark.createDataFrame([(0, ["aa", "bb", "aa"]), (1, []), (2, ["zz"])], "row_id long, tokens array<string>")
    got = dict(pooling.pool(docs, vectors, 2).select("row_id", vector_to_array("features")).collect())
    assert got[0] == pytest.approx([2 / 3, 2 / 3]) and got[1] == got[2] == [0.0, 0.0]
    asked = spark.createDataFrame([("aa",), ("aab",), ("qq",)], "token string")
    seen = pooling.with_unseen(asked, vectors, pooling.gram_vectors(vectors, 2), 2)
    found = {r.token: r.vector.toArray().tolist() for r in seen.collect()}
    assert found == {"aa": [1.0, 0.0], "aab": [1.0, 0.0]}


def test_pooling_ships_frequent_tokens_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(pooling, "SHIPPED_BYTES", 2 * (8 * 1 + 48))
    vectors = spark.createDataFrame([(t, Vectors.dense([v])) for t, v in (("aa", 1.0), ("bb", 2.0), ("cc", 4.0), ("dd", 8.0))], ["token", "vector"])
    texts = [["aa"] * 5 + ["bb"], ["bb", "cc"], ["dd", "zz", "aa"], [], ["zz"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id long, tokens array<string>")
    lines = docs.select(F.explode("tokens").alias("token"))
    often, rest = pooling._split(lines, vectors, 2)
    assert [{r.token for r in t.collect()} for t in (often, rest)] == [{"aa", "bb"}, {"cc", "dd"}]
    got = dict(pooling.pool(docs, vectors, 1).select("row_id", vector_to_array("features")).collect())
    assert [got[i][0] for i in range(5)] == pytest.approx([7 / 6, 3.0, 4.5, 0.0, 0.0])


@pytest.mark.parametrize("direct", [5, 10_000])
def test_quantiles_are_exact(spark, direct):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.exponential(1, 700).round(2), np.full(400, 1.25), rng.normal(9, 1, 101)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    shares = [0.0, 0.1, 0.5, 0.733, 0.9, 1.0]
    assert quantiles(df, "v", shares, direct) == pytest.approx(np.quantile(x, shares).tolist())


def test_thresholds(spark):
    x = np.random.default_rng(2).normal(size=201)
    df = spark.createDataFrame([(float(v),) for v in x], "score double")
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert iqr(df) == pytest.approx(q3 + 1.5 * (q3 - q1))
    assert mad(df) == pytest.approx(q2 + 3 * 1.4826 * np.median(np.abs(x - q2)))
    assert zscore(df) == pytest.approx(x.mean() + 3 * x.std())


def test_tail_counts_across_partitions(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(f), float(v)) for f, v in zip(rng.integers(0, 3, 2000), rng.integers(1, 300, 2000))]
    df = spark.createDataFrame(pairs, "feature_id int, value double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.feature_id, r.value): (r.weight, r.upto) for r in tail_counts(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    count = Counter(pairs)
    assert got == {k: (c, sum(n for (f, v), n in count.items() if f == k[0] and v <= k[1])) for k, c in count.items()}


@pytest.mark.parametrize("width", [2, 200])
@pytest.mark.parametrize("total", [False, True])
def test_vector_means(spark, width, total):
    x = np.random.default_rng(0).integers(0, 9, (12, width)).astype(float)
    df = spark.createDataFrame([(i % 3, float(1 + i % 2), Vectors.dense(r)) for i, r in enumerate(x)], ["g", "w", "v"])
    got = {r.g: r.v.toArray() for r in vector_mean(df, ["g"], "v", width, F.col("w"), total).collect()}
    w = np.array([1.0 + i % 2 for i in range(12)])
    for g in range(3):
        want = (x[g::3] * w[g::3, None]).sum(0) / (1 if total else w[g::3].sum())
        assert got[g] == pytest.approx(want)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(500, i) for i in range(501, 540)] + [(900, 900)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 500 for i in range(500, 540)}}


def test_metrics(spark):
    df = spark.createDataFrame([(-1, 1), (-1, 0), (1, 1), (1, 0), (1, 0)], "label int, y int")
    row = ev.with_measures(df.agg(*ev.counts(), *ev.confusion())).first()
    assert (row.tn, row.fp, row.fn, row.tp, row.n_samples, row.n_anomalies) == (2, 1, 1, 1, 5, 2)
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (0.6, 0.5, 0.5, 0.5)
    one_class = ev.with_measures(df.filter("label = 1 and y = 0").agg(*ev.confusion())).first()
    assert (one_class.tn, one_class.precision, one_class.recall, one_class.accuracy) == (2, 0.0, 0.0, 1.0)
    assert df.agg(ev.anomaly_recall()).first()[0] == 0.5


def test_tie_votes_flag(spark):
    labels = spark.createDataFrame([(0, -1), (0, 1), (1, 1), (1, 1)], "row_id long, label int")
    assert dict(ev.vote(labels, 2).collect()) == {0: -1, 1: 1}
    a = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 0.0)], "row_id long, score double")
    assert dict(ev.vote_cuts([(a, [0.5, 2.0, 2.5])]).collect()) == {0: -1, 1: 1, 2: 1}
    assert dict(ev.vote_cuts([(a, [0.5]), (a, [2.0])]).collect()) == {0: -1, 1: -1, 2: 1}
