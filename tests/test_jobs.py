import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlog import build_info, register_detector, register_feature, run
from oddlog.detectors.base import Fitted
from oddlog.plans import config as cf
from oddlog.plans.search import fold_of

PATTERN = r"[a-z]+\d*"
COUNT = "x.text.CountVectorizer"
TFIDF = "x.TfidfTransformerWrapper"
JOB = {
    "words": {
        "features": {
            "url": {
                COUNT: {"params": {"token_pattern": PATTERN, "lowercase": False, "max_df": 0.9, "max_features": 20}},
                TFIDF: {"params": {"norm": "none"}},
                "x.MinMaxScaler": {"params": {}},
            },
            "body": {"x.RatiosWrapper": {"params": {"lowercase": False}}},
        },
        "estimators": {
            "ECOD": [{"class": "x.ECOD", "grid": {"contamination": [0.1, 0.2, 0.3]}}],
            "knn": [{"class": "x.KNN", "params": {"method": "median"},
                     "grid": {"n_neighbors": [3, 5], "contamination": [0.1, 0.2]}}],
            "forest": [{"class": "x.IForest", "params": {"n_estimators": 10, "contamination": 0.2}}],
        },
    },
    "empty": {"features": {}, "estimators": {"e": [{"class": "x.ECOD"}]}},
}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        bad = i % 10 == 3
        url = "/shop/" + "-".join(rng.choice(["cart", "item", "home", "list"], 2)) + ("<%27%22>|{}" if bad else "")
        rows.append((i, url, "select " * 3 + "' or 1=1 <>" if bad else "plain text " + str(i), "attack" if bad else "norm"))
    return spark.createDataFrame(rows, "id long, url string, body string, label string").repartition(5)


def test_task_counts_and_names():
    assert cf.task_total(JOB, labelled=True) == 3
    assert cf.task_total(JOB, labelled=False) == 3 + 4 + 1
    knn = cf.estimators(JOB["words"]["estimators"])[1]
    assert [s.description for s in knn.settings][:2] == [
        "knn__contamination=0.1_n_neighbors=3", "knn__contamination=0.1_n_neighbors=5"]
    grid = {"c": {"x.CountVectorizer": {"grid": {"ngram_range": [[2, 2], [2, 3]], "lowercase": [True]}}}, "d": {"x.RatiosWrapper": {}}}
    assert [v.description for v in cf.feature_variants(grid)] == [
        "c__CountVectorizer(lowercase=True_ngram_range=(2, 2)) + d__RatiosWrapper",
        "c__CountVectorizer(lowercase=True_ngram_range=(2, 3)) + d__RatiosWrapper"]
    chain = dict(cf.feature_variants({"c": {"x.CountVectorizer": {}, "x.TruncatedSVD": {}}})[0].chains)["c"]
    assert [s.name for s in chain] == ["CountVectorizer", "densify", "nan_to_num", "TruncatedSVD"]


def test_info_and_label_checks():
    info = build_info(JOB, "t.csv", "label:no:rm")
    assert info["required_columns"] == ["body", "label", "url"] and info["y_config"] == ["label", "no:rm"]
    for labels, labelled in (("nocolon", True), (None, True), ("a:b", False)):
        with pytest.raises(ValueError):
            cf.parse_labels(labels, labelled)
    with pytest.raises(RuntimeError):
        cf.load_jobs("/no/such.json")


def test_threshold_replaces_the_grid_entry():
    spec = {"e": [{"class": "x.ECOD", "grid": {"contamination": [0.1]}, "threshold": {"contamination": "t.IQR"}}]}
    (found,) = cf.estimators(spec)
    assert found.threshold == "IQR" and not found.searched and found.settings[0].contamination is None


def test_folds_match_near_equal_contiguous_parts(spark):
    for n, k in ((10, 3), (7, 5), (14, 3), (5, 5)):
        want = np.concatenate([[i] * len(p) for i, p in enumerate(np.array_split(np.arange(n), k))])
        got = [r[0] for r in spark.range(n).orderBy("id").select(fold_of(F.col("id"), n, k)).collect()]
        assert got == want.tolist()


def test_labelled_rows(spark, table, tmp_path):
    target, results = str(tmp_path / "t"), str(tmp_path / "r")
    out = run(table, JOB, ["id"], labels="label:norm", folds=2, target_path=target, results_path=results)
    names = [m["name"] for m in out.metrics]
    head = "words__url__CountVectorizer__TfidfTransformerWrapper__MinMaxScaler + body__RatiosWrapper__"
    assert names == [head + "forest", head + "ECOD__grid", head + "knn__grid"]
    ecod = out.metrics[1]
    assert ecod["n_samples"] == 120 and ecod["recall"] == 1.0
    assert ecod["best_params"].startswith("{'ECOD__contamination'")
    assert json.loads(ecod["cv_results"])["params"][0] == {"ECOD__contamination": 0.1}
    matrix = ecod["confusion_matrix"]
    assert matrix["true_positives"] == 12 and sum(matrix.values()) == 120
    back = spark.read.csv(target, sep=";", header=True)
    assert {r.task: r["count"] for r in back.groupBy("task").count().collect()} == {m["name"]: m["n_anomalies"] for m in out.metrics}
    assert spark.read.csv(results, sep=";", header=True).count() == 3
    assert out.frame(spark).count() == 3


def test_unlabelled_rows_vote_within_an_estimator(spark, table):
    out = run(table, JOB, ["id"])
    names = [m["name"].rpartition("RatiosWrapper__")[2] for m in out.metrics]
    assert names == [
        "ECOD__contamination=0.1", "ECOD__contamination=0.2", "ECOD__contamination=0.3", "ECOD__voted",
        "knn__contamination=0.1_n_neighbors=3", "knn__contamination=0.1_n_neighbors=5",
        "knn__contamination=0.2_n_neighbors=3", "knn__contamination=0.2_n_neighbors=5", "knn__voted", "forest",
    ]
    by_name = dict(zip(names, out.metrics))
    # Two of three cuts flag exactly what the middle one flags.
    assert by_name["ECOD__voted"]["n_anomalies"] == by_name["ECOD__contamination=0.2"]["n_anomalies"]
    assert by_name["ECOD__voted"]["n_models"] == 3
    assert [t.rpartition("__")[2] for _, t in out.flagged] == ["voted", "voted", "forest"]
    assert "accuracy" not in by_name["forest"]


def test_windows_both_ways(spark, table):
    job = {"w": {"features": {"body": JOB["words"]["features"]["body"]},
                 "estimators": {"ECOD": [{"class": "x.ECOD", "grid": {"contamination": [0.1, 0.4]}}]}}}
    window = {"size": 6, "overlap": 2}
    out = run(table, job, ["id"], mode="sequence", window=window)
    first, second, voted = out.metrics
    assert first["n_sequences"] == 29 and first["n_rows"] == 120
    assert voted["n_seq_anomalies"] == second["n_seq_anomalies"]
    assert voted["n_row_anomalies"] == out.flagged[("w", voted["name"])].count() > 0
    assert json.loads(voted["sequence_config"]) == {"size": 6, "method": "mean", "overlap": 2}
    judged = run(table, job, ["id"], mode="sequence", labels="label:norm", window=window, folds=2)
    (row,) = judged.metrics
    assert row["n_samples"] == 29 and row["n_row_anomalies"] > 0 and "recall" in row
    assert run(table, job, ["id"], mode="sequence", window={"size": 500}).metrics == []


def test_own_steps_and_detectors(spark, table):
    class Length:
        neighbours = 0

        def fit(self, rows, shared=None):
            return Fitted(rows.select("row_id", F.get(F.unwrap_udt("features")["values"], F.lit(0)).alias("score")))

    register_feature("CharCount", lambda df, column, resources: df.withColumn(column, F.length(column)))
    register_detector("Largest", Length)
    job = {"j": {"features": {"url": {"my.CharCount": {}}}, "estimators": {"big": [{"class": "my.Largest"}]}}}
    out = run(table, job, ["id"])
    assert out.metrics[0]["n_anomalies"] == 12


def test_pooling_hashing_and_vector_steps(spark, table):
    job = {"p": {
        "features": {
            "url": {"x.DocumentPoolWrapper": {"params": {"model": "vectors", "pattern": PATTERN}}},
            "body": {"x.HashingVectorizer": {"params": {"n_features": 64}}, "x.TruncatedSVD": {"params": {"n_components": 2}}},
        },
        "estimators": {"vae": [{"class": "x.MinMaxScaler"}, {"class": "x.VAE", "params": {"epoch_num": 20}}]},
    }}
    from pyspark.ml.linalg import Vectors

    vectors = spark.createDataFrame([("shop", Vectors.dense([1.0, 0.0])), ("cart-item", Vectors.dense([0.0, 1.0]))], ["token", "vector"])
    out = run(table, job, ["id"], resources={"vectors": vectors})
    assert out.metrics[0]["n_samples"] == 120


def test_hits_with_dotted_columns(spark, tmp_path):
    lines = [
        {"_id": f"{i:03}", "_index": "logs", "_source": {"rule": {"rule": "<<%27 zq>> {}" if i == 17 else f"alert tcp any port {i % 7} msg scan"}, "tags": ["a"]}}
        for i in range(60)
    ]
    (tmp_path / "hits.json").write_text("\n".join(map(json.dumps, lines)))
    from oddlog import HitSource

    hits = HitSource(spark, str(tmp_path / "hits.json"), query={"_source": ["rule.rule", "tags"]}).load(["rule.rule"])
    jobs = {
        "tfidf_vae": {
            "features": {"rule.rule": {
                COUNT: {"params": {"token_pattern": PATTERN, "lowercase": False, "max_df": 0.7, "max_features": 50, "analyzer": "char", "ngram_range": [2, 2]}},
                TFIDF: {"params": {"norm": "l1"}}}},
            "estimators": {"vae": [{"class": "x.VAE", "grid": {"contamination": [0.1]}}]},
        },
        "ratio": {
            "features": {"rule.rule": {"x.RatiosWrapper": {"params": {"lowercase": False}}}},
            "estimators": {"forest": [{"class": "x.IForest", "params": {"n_estimators": 5}, "grid": {"contamination": [0.1]}}]},
        },
    }
    target = str(tmp_path / "out")
    out = run(hits, jobs, ["_id"], target_path=target)
    assert [m["name"] for m in out.metrics] == [
        "tfidf_vae__rule.rule__CountVectorizer__TfidfTransformerWrapper__vae__contamination=0.1",
        "ratio__rule.rule__RatiosWrapper__forest__contamination=0.1"]
    back = spark.read.csv(target, sep=";", header=True)
    assert back.columns == ["rule.rule", "tags", "_id", "_index", "task", "strategy", "task_key"]
    assert back.count() == sum(m["n_anomalies"] for m in out.metrics) > 0


def test_trained_encodings_and_remaining_detectors(spark, table):
    jobs = {"j": {
        "features": {
            "url": {"x.DocumentPoolWrapper": {"params": {"pattern": PATTERN, "size": 4}}},
            "body": {COUNT: {"params": {"min_df": 2}}, "x.AutoencoderWrapper": {"params": {"hidden_neurons": [8, 2], "epochs": 3}}},
        },
        "estimators": {
            "lof": [{"class": "x.LOF", "grid": {"n_neighbors": [5, 10]}}],
            "lunar": [{"class": "x.LUNAR", "params": {"n_neighbours": 5}}],
            "hdbscan": [{"class": "x.HDBSCAN", "params": {"min_cluster_size": 4}, "threshold": {"contamination": "t.MAD"}}],
        },
    }}
    out = run(table, jobs, ["id"])
    assert [m["name"].split("__")[-1] for m in out.metrics] == ["n_neighbors=5", "n_neighbors=10", "voted", "lunar", "hdbscan"]
    assert all(m["n_samples"] == 120 for m in out.metrics)
