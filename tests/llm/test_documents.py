"""Exact dedup, decontamination, mixing, token counts: definitions by hand on small and odd input."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oddlog.llm import decontaminate as dc, exact, mixing, tokens

CLASHES = {"length": "x", "opening": 1, "row": 2, "full": None, "size": 3, "key": "k", "words": "w", "_row": 9, "source_": "s"}
SCHEMA = "doc_id long, text string, source string, " + ", ".join(
    f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in CLASHES.items()
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASHES.values()) for r in rows], SCHEMA).coalesce(3)


ODD = [
    (1, "a b", "s"), (2, "a\t\n b", "s"), (2, "a b", "t"), (3, None, "s"), (4, "", None), (None, "a b", None), (None, None, "s"),
    (7, " a b", "s"), (8, "x " * 60_000, "s"), (9, "x " * 60_000 + "y", "s"), (10, "x " * 60_000, "s"), (11, "A b", "s"),
]


def test_exact_groups(spark):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(frame(spark, ODD)).collect())
    assert got == Counter([
        (1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False), (3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False),
        (7, 7, 1, True), (8, 8, 2, True), (10, 8, 2, False), (9, 9, 1, True), (11, 11, 1, True),
    ])
    kept = exact.exact_dedup(frame(spark, ODD))
    assert kept.columns == ["doc_id", "text", "source", *CLASHES]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7, 8, 9, 11]


def test_exact_repeated_rows_and_nothing(spark):
    rows = [(5, "same", "s")] * 4 + [(None, "other", "s")] * 2
    assert Counter(r.kept for r in exact.exact_groups(frame(spark, rows)).collect()) == {True: 2, False: 4}
    assert exact.exact_dedup(frame(spark, rows)).count() == 2
    assert exact.exact_groups(frame(spark, [])).count() == 0


def plain_set(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("seed", range(2))
def test_contaminated_against_all_pairs(spark, seed):
    random.seed(seed)
    word = lambda: f"w{random.randint(0, 300)}"
    items = [" ".join(word() for _ in range(random.choice([1, 4, 5, 6, 9, 20, 45, 130]))) for _ in range(30)] + ["", None]
    docs = []
    for _ in range(80):
        out = [word() for _ in range(random.randint(0, 300))]
        for _ in range(random.randint(0, 2)):
            passage = (random.choice(items) or "").split()
            for _ in range(random.choice([0, 0, 1, 1, 2])):
                if passage:
                    passage[random.randrange(len(passage))] = word().upper() + ","
            out[len(out) // 2 : len(out) // 2] = passage
        docs.append(random.choice([" ", "\n", ", "]).join(out))
    docs += [None, "", items[0], *[i for i in items if i and len(i.split()) < 5]]
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, key string")
    i = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, needed int")
    want = {}
    for a, text in enumerate(docs):
        for b, item in enumerate(items):
            s, t = plain_set(text), plain_set(item)
            if t and 100 * len(s & t) >= 80 * len(t):
                want[(a, b)] = (len(s & t), len(t))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in dc.contaminated(d, i).collect()}
    assert got == want and len(want) > 20
    assert {r.doc_id for r in dc.decontaminate(d, i).collect()} == set(range(len(docs))) - {a for a, _ in want}


def test_contaminated_nulls_ties_and_nothing(spark):
    text = "one two three four five six seven"
    d = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(None, text), (7, text), (7, "other words in this item too")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, i).collect()} == {(None, None), (None, 7), (1, None), (1, 7)}
    assert sorted(r.doc_id for r in dc.decontaminate(d, i).collect()) == [2, 3]
    assert dc.contaminated(d, i.limit(0)).count() == 0 and dc.contaminated(d.limit(0), i).count() == 0


def test_mixing_rates(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source")
    )
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = mixing.mix(docs, {"big": 1.0, "small": 1.0, "absent": 5.0})
    # Weights of absent sources do not count: both halves are of one size.
    count = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(count["big"] - 10_000) < 400 and abs(count["small"] - 10_000) < 400
    rate = {"big": 10_000 / 14_000, "small": 10_000 / 6_000}
    copies = Counter((r.source, r.n) for r in out.groupBy("source", "doc_id").agg(F.count("*").alias("n")).collect())
    from math import exp, factorial
    for source, total in (("big", 14_000), ("small", 6_000)):
        for k in (1, 2, 3):
            p = exp(-rate[source]) * rate[source] ** k / factorial(k)
            assert abs(copies[(source, k)] / total - p) < 0.02
    keys = [r.shuffle_key for r in out.collect()]
    assert len(set(keys)) == len(keys)
    again = mixing.mix(docs.repartition(3), {"big": 1.0, "small": 1.0, "absent": 5.0})
    assert sorted(keys) == sorted(r.shuffle_key for r in again.collect())


def test_mixing_odd_rows(spark):
    out = mixing.mix(frame(spark, ODD), alpha=1.0)
    assert set(out.columns) == {*frame(spark, ODD).columns, "copy_no", "shuffle_key"}
    assert {r.source for r in out.collect()} <= {"s", "t", None}
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, "", "s"), (2, None, "s")])).count() == 0
    assert mixing.mix(frame(spark, ODD), {"none": 1.0}).count() == 0
    large = mixing.source_rates(frame(spark, [(k, "x" * (1 if k else 5_000), "a" if k == 0 else "b") for k in range(2)]), {"b": 1.0}, 0.5)
    row = {r.source: r for r in large.collect()}["b"]
    assert row.rate == 5001 and len(row.steps) > 5001 and abs(row.steps[-1] - 1) < 1e-6


TEXTS = [
    None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "a   b", "a\nb c\n", "a \n b", "  x   y", "don't you'll 's 't",
    "x" * 5000, "tail  ", "tail \n", "<|endoftext|> a <|endoftext|>", "日本語 のテキスト 12345 ,,, ...", "a\tb\t c", "\r\n\r\n  z", "é" * 100 + " ok",
    " ".join(f"word{k % 700}" for k in range(20_000)),
]


def test_token_counts(spark):
    random.seed(2)
    texts = TEXTS + ["".join(random.choice(" \n\tab1é.,'’ ") for _ in range(random.randint(1, 60))) for _ in range(400)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(4)
    got = sorted(tuple(r) for r in tokens.token_counts(df, path).collect())
    assert got == [(*w, w[2] > 512) for w in want]
    assert tokens.token_counts(df.limit(0), path).count() == 0


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    counts = tokens.Counts(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(40):
        text = " ".join(f"word{k * 7 + j}" for j in range(30))
        assert counts.text(text) == counts.encode([text])[0]
        assert len(counts.cache) <= 50


def test_digest_of_the_query(spark):
    from oddlog.llm.queries import op8_exact_dedup

    rows = {r.doc_id: r for r in op8_exact_dedup(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect():
        norm = re.sub(r"[\x20\x09-\x0d]+", " ", d.text)
        assert rows[d.doc_id].text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
