"""Substring dedup against a dictionary of every window."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oddlog.llm import words as hashing
from oddlog.llm.substring import COVER, PERIOD, substring_dedup


def brute(texts, window):
    split = [[w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, texts, window=35):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5, "doc_id")
    df = df.withColumn("row", F.lit("clash")).withColumn("pos", F.lit(None).cast("string"))
    df = spark.createDataFrame(df.collect(), df.schema)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, window).collect())
    assert got == [(k, *row) for k, row in enumerate(brute(texts, window))]


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    random.seed(seed)
    word = lambda: random.choice(["a", "b", "été", "dd", "x" * random.randint(1, 9)]) + str(random.randint(0, 400))
    passages = [[word() for _ in range(random.randint(30, 60))] for _ in range(8)]
    texts = []
    for _ in range(60):
        out = []
        for _ in range(random.randint(0, 4)):
            out += [word() for _ in range(random.randint(0, 70))]
            out += random.choice(passages)[random.randint(0, 6) :]
        texts.append(random.choice([" ", "\n", " \t "]).join(out))
    check(spark, [*texts, None, "", "   ", texts[0], texts[0], " ".join(["same"] * 90), " ".join(["p", "q"] * 30)])


def test_short_and_empty(spark):
    check(spark, ["a b c", "a b c", None, ""])
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = " ".join(f"w{k}" for k in range(35))
    check(spark, [one, one + " more", "x " + one[:-1]])


def test_small_blocks_and_slices(spark, monkeypatch):
    rows = [" ".join(f"w{k % 50}" for k in range(n)) for n in (0, 34, 35, 36, 120)]
    data, offsets = hashing.text_buffers(__import__("pyarrow").array(rows))
    whole, ends = hashing.Words().hashes(data, offsets)
    monkeypatch.setattr(hashing, "BLOCK", 16)
    cut, cut_ends = hashing.Words().hashes(data, offsets)
    assert (whole == cut).all() and (ends == cut_ends).all()


def test_query_on_the_small_tables(spark):
    from oddlog.llm.queries import op1_substring_dedup

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = [(d.doc_id, *row) for d, row in zip(docs, brute([d.text for d in docs], 35))]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, sf).collect()) == want
    assert any(w[2] for w in want)


def test_window_below_the_period_is_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 20)
