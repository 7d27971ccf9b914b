import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oddlog.functions import text
from oddlog.functions.ratios import entropy, ratio_columns, ratio_struct, with_meaning, words_table
from oddlog.functions.rows import as_list, finite, is_anomaly, typed_fill

SAMPLES = [
    "GET /index.php?id=12&name=abc%27 <script>", "Élan überß 東京 ١٢", "a\x1cb\tc d", "%zz%2F%2f",
    "aaaa", "{}~^`[]|<>", "😀 hi 😀", " ", "éèá", "", None,
]


def expected(s):
    s = s or ""
    n = len(s)
    if not n:
        return dict.fromkeys(("alnum", "special", "illegal", "encoded", "entropy", "vowel", "consonant"), 0.0)
    shares = [c / n for c in Counter(s).values()]
    return {
        "alnum": sum(c.isalnum() for c in s) / n,
        "special": sum(not (c.isalnum() or c.isspace()) for c in s) / n,
        "illegal": sum(c in "<>|{}~^`[]" for c in s) / n,
        "encoded": 3 * len(re.findall("%[0-9a-fA-F]{2}", s)) / n,
        "entropy": -sum(p * math.log2(p) for p in shares),
        "vowel": sum(c in "aeiouAEIOU" for c in s) / n,
        "consonant": sum(c.isalpha() and c not in "aeiouAEIOU" for c in s) / n,
    }


def test_ratios_equal_the_definition(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "row_id int, s string")
    columns = df.select("row_id", *[c.alias(n) for n, c in ratio_columns(F.col("s")).items()])
    batch = df.select("row_id", ratio_struct(F.col("s")).alias("r")).select("row_id", "r.*")
    for row in columns.collect() + batch.collect():
        want = expected(SAMPLES[row.row_id])
        assert {n: row[n] for n in want} == pytest.approx(want), SAMPLES[row.row_id]


def test_lowercase_first(spark):
    df = spark.createDataFrame([("AaB",)], "s string")
    assert df.select(entropy(F.col("s"), lowercase=True)).first()[0] == pytest.approx(expected("aab")["entropy"])


@pytest.mark.parametrize("limits", [(500, 1000), (0, 1000), (0, 0)])
def test_meaning_takes_the_longest_word_first(spark, limits):
    words = words_table(spark.createDataFrame([("in",), (" Index ",), ("dexter",), ("x",), ("c++",), ("ex",)], "word string"))
    texts = ["INDEXTER in", "c++c+", "", None, "xxxx", "ininin", "indexindex"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, s string")
    got = dict(with_meaning(df, F.col("s"), words, regex_words=limits[0], shipped_words=limits[1]).select("row_id", "meaning").collect())
    want = [7 / 11, 3 / 5, 0.0, 0.0, 0.0, 1.0, 1.0]
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_meaning_without_words_is_zero(spark):
    df = spark.createDataFrame([(1, "abc")], "row_id long, s string")
    assert with_meaning(df, F.col("s"), None).first().meaning == 0.0


SHIPPED = r"\b(?![0-9]+\b)(?![0-9]+[.\-][0-9.\-]*\b)(?!(?:[0-9a-fA-F]{2}){2,}\b)[a-zA-Z0-9._\-%]{3,32}\b"


@pytest.mark.parametrize("s,want", [
    ("GET /index.php?id=12&name=abc%27 DEADBEEF 1.2.3 x-y.z9", ["GET", "index.php", "name", "abc%27", ".2.3", "x-y.z9"]),
    ("ABCD 12ab-34 foo.bar.", ["-34", "foo.bar"]),
    (None, []),
])
def test_shipped_token_pattern(spark, s, want):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(text.word_tokens(F.col("s"), SHIPPED, lowercase=False)).first()[0] == want


@pytest.mark.parametrize("kwargs,want", [
    ({}, ["ab", "cd", "ef"]),
    ({"ngram_range": (1, 2)}, ["ab", "cd", "ef", "ab cd", "cd ef"]),
    ({"ngram_range": (4, 4)}, []),
    ({"analyzer": "char", "ngram_range": (2, 2)}, ["ab", "b ", " c", "cd", "d ", " e", "ef"]),
    ({"analyzer": "char", "ngram_range": (9, 9)}, []),
])
def test_terms(spark, kwargs, want):
    df = spark.createDataFrame([("Ab   cd Ef",)], "s string")
    assert df.select(text.terms(F.col("s"), **kwargs)).first()[0] == want


def test_row_projections(spark):
    df = spark.createDataFrame([(None, None, None, float("inf")), (1, "x", 2.0, 3.0)], "i int, s string, d double, e double")
    out = df.select(typed_fill(df, "i"), typed_fill(df, "s"), typed_fill(df, "d"), finite(F.col("e"))).collect()
    assert [tuple(r) for r in out] == [(0, "", 0.0, 0.0), (1, "x", 2.0, 3.0)]
    labels = spark.createDataFrame([("Normal",), ("bad",), (None,)], "y string")
    assert [r[0] for r in labels.select(is_anomaly(F.col("y"), "Normal")).collect()] == [0, 1, 1]
    assert df.select(as_list(df, "s")).collect()[1][0] == ["x"]
