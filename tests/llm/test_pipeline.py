"""The pipeline stage by stage against brute force on planted documents."""

import os
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from oddlog.llm import exact, quality  # noqa: E402


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A small corpus: prose, junk, copies, near copies, benchmark passages, odd rows and columns."""
    random.seed(4)
    word = lambda: "".join(random.choice(["th", "er", "an", "re", "on"]) for _ in range(random.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [prose(30) for _ in range(5)]
    good = [prose(random.randint(60, 200)) for _ in range(120)]
    junk = [" ".join(word().upper() + "!!" for _ in range(80)) for _ in range(60)]
    texts = good + junk + good[:15] + [g.replace(" ", "\n", 3) for g in good[15:20]] + [g + " more" for g in good[20:35]]
    texts += [good[40 + k] + " " + items[k % 5] + " " + prose(50) for k in range(10)] + [None, "", ""]
    order = list(range(len(texts)))
    random.shuffle(order)
    rows = [(k, texts[o], "en", f"s{k % 3}", len(texts[o] or "")) for k, o in enumerate(order)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(texts[o] not in junk), 0) for k, o in enumerate(order) if k % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {r[0]: r[1] for r in rows}, items


def test_stages_against_brute_force(spark, planted):
    folder, texts, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality.classify(docs, model).collect() if r.predicted}
    assert not any("!!" in (texts[k] or "") for k in good) and len(good) > 150

    import re
    seen, unique = set(), set()
    for k in sorted(good):
        norm = re.sub(r"[\x20\x09-\x0d]+", " ", texts[k] or "")
        if norm not in seen:
            seen.add(norm)
            unique.add(k)
    shingles = lambda t, n: {tuple(w[k : k + n]) for w in [t.lower().split()] for k in range(len(w) - n + 1)} or ({tuple(t.lower().split())} - {()})
    sets = {k: shingles(texts[k] or "", 5) for k in unique}
    root = {k: k for k in unique}
    for a in unique:
        for b in unique:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    apart = {k for k in unique if root[k] == k}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    wanted = [shingles(plain(i), 5) for i in items]
    clean = {k for k in apart if not any(len(w & shingles(plain(texts[k] or ""), 5)) >= 0.8 * len(w) for w in wanted)}
    assert len(good) > len(unique) > len(apart) > len(clean) > 80

    frame, stages = docs, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, folder)
        out.write.parquet(f"{folder}/stage{n}")
        frame = spark.read.parquet(f"{folder}/stage{n}")
        if n < 4:
            assert frame.columns == docs.columns
        stages.append(sorted(r.doc_id for r in frame.select("doc_id").collect()))
    for found, want in zip(stages, (good, unique, apart, clean)):
        assert found == sorted(want)
    assert set(stages[4]) <= clean and set(frame.columns) == {*docs.columns, "copy_no", "shuffle_key"}
    again = sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())
    assert again == stages[4]


def test_odd_input(spark, planted, tmp_path):
    folder, _, _ = planted
    rows = [(None, None, None, None, None), (1, "ab " * 5000, "en", "s", 9), (1, "ab " * 5000, "en", "s", 9), (2, "", None, "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, _row int, row int, words string"
    for data in ([(*r, "x", 1, 2, "w") for r in rows], []):
        docs = spark.createDataFrame(data, schema)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert out.columns[: len(docs.columns)] == docs.columns
            out.collect()
    assert exact.exact_dedup(spark.createDataFrame([(*r, "x", 1, 2, "w") for r in rows], schema)).count() == 2


def test_near_copies_share_four_fifths_of_five_word_runs(spark):
    words = [f"w{k}" for k in range(100)]
    changed = [w if k not in (40, 60) else "x" for k, w in enumerate(words)]  # 86 of 106 runs of five words, 92 of 104 of three
    far = [w if k % 30 > 1 else f"z{k}" for k, w in enumerate(words)]  # 76 of 116 runs of five words
    rows = [(k, " ".join(w)) for k, w in enumerate((words, changed, far))]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_rows_go_by_their_text_not_by_id(spark, tmp_path):
    words = [f"w{k}" for k in range(100)]
    base, near, near2 = (" ".join([*words, *more]) for more in ([], ["x"], ["y"]))
    clean, clean2 = (" ".join(f"{c}{k}" for k in range(50)) for c in "cd")
    schema = "doc_id long, text string"
    rows = [(1, base), (1, near), (5, clean), (5, near2), (None, clean2), (None, base + " z")]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), "")
    assert sorted(r.text for r in out.collect()) == sorted([base, clean, clean2])
    spark.createDataFrame([(1, base)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.drop_benchmark(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    assert sorted(r.text for r in out.collect()) == sorted([clean, clean2])
