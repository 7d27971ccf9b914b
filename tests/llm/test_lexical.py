"""Treap search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from oddlog.llm import lexical
from oddlog.llm.lexical import Treap, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=20):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [len(t) for _, t in terms if t]
    n, total = len(held), sum(held)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scores = []
        for doc, t in terms:
            m = 100 - 25 + 25 * len(t) * n // total if total else 0
            s = 0
            for q in asked:
                df, tf = sum(q in set(x) for _, x in terms), t.count(q)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(4),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def corpus(seed, n):
    random.seed(seed)
    word = lambda: random.choice(["the", "of", "Übung", "x-y", "a.b"]) if random.random() < 0.5 else f"w{int(random.expovariate(0.02))}"
    docs = [(k, " ".join(word() for _ in range(random.choice([1, 5, 30, 80])))) for k in range(n)]
    docs += [(n + k, docs[k][1]) for k in range(30)]  # equal scores
    return docs, [(k, " ".join(word() for _ in range(12))) for k in range(6)]


@pytest.mark.parametrize("seed", range(2))
def test_against_all_documents(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 3000)  # many trees
    monkeypatch.setattr(lexical, "OPEN", 5)
    docs, items = corpus(seed, 150)
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search(*frames(spark, docs, items)).collect())
    assert got == brute(docs, items) and len(got) == 120


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 20)
    docs, items = corpus(7, 60)
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search(*frames(spark, docs, items)).collect())
    assert got == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--"), (4, "One two"), (4, "one two"), (None, "ONE two"), (6, "three " * 9000 + "one")]
    items = [(1, "one"), (2, None), (3, "..."), (4, "missing"), (5, "two TWO")]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search(*frames(spark, docs, items)).collect()), key=repr)
    assert got == sorted(brute(docs, items), key=repr) and len(got) == 7
    assert ranked_search(*frames(spark, [], items)).count() == 0 and ranked_search(*frames(spark, docs, [])).count() == 0


def test_tree_maxima_bound_every_cell():
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, [13, 90], (300, 2)), axis=0)
    impact = rng.integers(1, 1000, len(pairs))
    tree = Treap(pairs[:, 0], pairs[:, 1], impact)
    grid = np.zeros((13, 90), np.int64)
    grid[pairs[:, 0], pairs[:, 1]] = impact
    row, weight = np.array([0, 3, 12]), np.array([2, 1, 5])
    scores = weight @ grid[row]
    column, found = tree.best(row, weight, 7, 1)
    bar = np.sort(scores)[-7]
    assert sorted(column.tolist()) == np.flatnonzero((scores >= bar) & (scores > 0)).tolist() and (scores[column] == found).all()
