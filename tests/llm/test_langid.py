"""Language codes: held-out accuracy on the tables, counts and margins by brute force, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlog.llm import langid

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def test_held_out_accuracy(docs, model):
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    told = [r for r in rows if r.held_out and r.lang_pred != "und" and r.lang]
    assert len(told) > 20 and sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_do_not_use_labels(docs, model):
    want = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    bare = docs.select("doc_id", "text").repartition(7)
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(bare, model).collect()} == want
    hidden = docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang")))
    assert (langid.fit(hidden.repartition(3)).weights == model.weights).all()


def test_counts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "_STEP", 7)
    texts = ["Ab c!", None, "naïve-é", "x", "ab ab ab ab 9"]
    rows = spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    learning = rows.select((F.col("doc_id") % 2).cast("int").alias("language"), langid.letters(F.col("text")).alias("plain"))
    want = [Counter(), Counter()]
    for r in learning.collect():
        data = r.plain.encode()
        for n in langid.GRAMS:
            for k in range(len(data) - n + 1):
                gram = data[k : k + n]
                if gram != b" ":
                    key = np.array([int.from_bytes(gram, "big") + (n << 40)], np.uint64)
                    want[r.language][int(langid.mix(key)[0] % np.uint64(langid.BUCKETS))] += 1
    got = langid.gram_counts(learning.repartition(3), 2)
    assert [Counter({k: int(v) for k, v in enumerate(line) if v}) for line in got] == want


def test_margins_do_not_turn_on_slices(model, monkeypatch):
    texts = [" das ist ein haus ", " ", " la maison est belle et grande ", "  "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = model.margins(data, offsets)
    monkeypatch.setattr(langid, "_STEP", 3)
    assert (model.margins(data, offsets) == whole).all()


@pytest.mark.parametrize("n", [2, 4, 6, 9, 40])
def test_codewords_stand_apart(n):
    code = langid.codewords(n)
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= max(1, code.shape[1] // 4) and set(np.unique(code)) == {-1, 1}


def test_odd_rows(spark, model):
    schema = "doc_id long, text string, lang string, plain string, has int"
    rows = [(1, None, "fr"), (2, "", "fr"), (3, "12 !! 34", "de"), (4, "the " * 50_000, "en"), (None, "the with and", None), (4, "the", "en")]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = langid.identify(odd, model).collect()
    assert len(got) == 6
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3 and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(r.lang_pred == "en" for r in got if r.doc_id == 4) and not any(r.held_out for r in got if r.doc_id is None)
    empty = odd.limit(0)
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    one = langid.fit(spark.createDataFrame([(0, "uno dos", "es")], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.identify(odd, one).collect() if r.doc_id == 4] == ["es", "es"]
