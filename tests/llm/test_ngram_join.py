"""The prefix-tree join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlog.llm import ngram_join as nj
from oddlog.llm.ngram_join import near_classes


def brute(texts, num=90, den=100, n=3):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [(k, len(s), r) for k, (s, r) in enumerate(zip(sets, root))]


def frame(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumn("k1", F.lit("x")).withColumn("node", F.lit(None).cast("int")).repartition(6)


def got(df, **kwargs):
    return sorted(tuple(r) for r in near_classes(df, **kwargs).collect())


def corpus(seed, rows=150):
    random.seed(seed)
    word = lambda: random.choice("the of and to".split()) if random.random() < 0.4 else f"w{random.randint(0, 900)}"
    bases = [[word() for _ in range(random.choice([1, 2, 3, 12, 14, 25, 40, 80, 300]))] for _ in range(25)]
    texts = []
    for _ in range(rows):
        text = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
            k = random.randrange(len(text) or 1)
            text[k : k + 1] = random.choice([[word()], [], [*text[k : k + 1], word()], [w.upper() for w in text[k : k + 1]]])
        texts.append(" ".join(text))
    return [*texts, None, "", "  ", "one", "One", "one two"]


@pytest.mark.parametrize("seed", range(3))
def test_all_links_are_found(spark, seed):
    texts = corpus(seed)
    assert got(frame(spark, texts)) == brute(texts)


def test_other_thresholds(spark):
    texts = corpus(9, 80)
    assert got(frame(spark, texts), n=5, num=80) == brute(texts, 80, 100, 5)


@pytest.mark.parametrize("chunk, sets", [(1, 512), (400, 3)])
def test_large_leaders_meet_in_chunks(spark, monkeypatch, chunk, sets):
    monkeypatch.setattr(nj, "CHUNK", chunk)
    monkeypatch.setattr(nj, "CHUNK_SETS", sets)
    texts = corpus(5)
    assert got(frame(spark, texts)) == brute(texts)


def family(copies):
    """One text and copies of it that differ in a word each, beside texts that share a passage of it only."""
    random.seed(8)
    base = [f"w{random.randint(0, 5000)}" for _ in range(120)]
    near = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(copies) for k in [random.randrange(120)]]
    return near + [" ".join([*base[:60], *(f"y{random.randint(0, 9999)}" for _ in range(90))]) for _ in range(copies)]


def test_rows_into_the_join_grow_with_the_sets(spark):
    for copies in (100, 200):
        texts = family(copies)
        rows = frame(spark, texts).select("doc_id", "text")
        counts = nj.gram_counts(rows, 5)
        scan = nj._scan(rows, 5, 80, 100, 8, counts).filter("part IS NOT NULL").select("part", "gram", "class", "size")
        led = scan.groupBy("part").applyInArrow(nj._leaders(80, 100, 3), nj.PACKED_LED).groupBy("bin").applyInArrow(nj._with_enough(80, 100), nj.LED)
        assert led.count() <= 3 * len(texts)
        assert got(frame(spark, texts), n=5, num=80) == brute(texts, 80, 100, 5)


def test_empty_repeated_and_null_ids(spark):
    assert near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text), (1, "other words here"), (2, text + " x"), (None, text), (None, None)]
    df = near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r.doc_id, r.component_id) for r in df.collect()), key=repr)
    assert found == sorted([(1, 1), (1, 1), (1, 1), (2, 1), (None, 1), (None, None)], key=repr)


def test_linked_sets_share_a_rare_gram():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, nj.SLOTS).astype(np.uint32)
    for size in [*range(1, 80), 150, 400, 900]:
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for drop in range(0, max(1, size // 18) + 1):
            for add in range(0, max(1, size // 18) + 1, max(1, size // 60)):
                other = np.unique(np.concatenate([base[: len(base) - drop], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
                same = len(np.intersect1d(base, other))
                if 100 * same < 90 * (len(base) + len(other) - same):
                    continue
                sets, grams = nj.rarest(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]), counts, 90, 100)
                shared = np.intersect1d(grams[sets == 0], grams[sets == 1]).size
                assert shared >= nj.depth(np.array([len(base), len(other)]), 90, 100).min() >= 1


def test_frequent_passages_are_not_rare_grams(spark):
    """Texts that share a passage and nothing else go to no leader."""
    random.seed(3)
    passage = [f"p{k}" for k in range(30)]
    texts = [" ".join([*passage, *(f"w{random.randint(0, 10**9)}" for _ in range(70))]) for _ in range(200)]
    rows = frame(spark, texts).select("doc_id", "text")
    counts = nj.gram_counts(rows, 5)
    scan = nj._scan(rows, 5, 80, 100, 8, counts).filter("part IS NOT NULL").select("part", "gram", "class", "size")
    found = scan.groupBy("part").applyInArrow(nj._leaders(80, 100, 3), nj.PACKED_LED)
    assert found.groupBy("bin").applyInArrow(nj._with_enough(80, 100), nj.LED).count() < 10
