"""Quality by a sparse rule ensemble: tree paths over text statistics, weighed by a lasso logistic regression.

Statistics are column expressions over the whole text. A small forest learns on a bounded sample of labelled rows
(`SAMPLE`, the rows of least hash), every path of its trees is a rule (a conjunction of cuts), and the lasso keeps few
of them. The kept rules are compiled into one column expression, so scoring is a projection without Python or shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.llm.common import WHITE, fresh, text_of
from oddlog.session import freeze

SAMPLE = 20_000  # labelled rows at most that a fit reads
TREES, DEPTH, LASSO, SEED = 12, 3, 0.002, 11
STATISTICS = (
    "log_chars", "word_chars", "capitals", "marks", "exclamations", "pipes", "digits", "distinct_words", "distinct_lines",
)


def statistics(text: Column) -> list[Column]:
    """The statistics of a text, named as in STATISTICS; empty texts have 0 everywhere."""
    chars, words, lines = F.length(text), F.split(F.trim(text), WHITE), F.split(text, "\n")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    values = (
        F.log1p(chars), chars / F.size(words), share(r"\p{Lu}"), share("[#$%&*@^~<>{}=]"), share("!"), share(r"\|"), share("[0-9]"),
        F.size(F.array_distinct(words)) / F.size(words), F.size(F.array_distinct(lines)) / F.size(lines),
    )
    return [F.when(chars > 0, v.cast("double")).otherwise(0.0).alias(n) for n, v in zip(STATISTICS, values)]


Rule = frozenset  # of (statistic, "<=" or ">", cut)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: dict[Rule, float]

    def score(self, names: dict[str, str]) -> Column:
        """Probability of label 1; `names` says which column holds which statistic."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule, names), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, names: dict[str, str]) -> Column:
    out = F.lit(True)
    for name, side, cut in sorted(rule):
        column = F.col(names[name])
        out = out & (column <= cut if side == "<=" else column > cut)
    return out


def tree_rules(text: str) -> set[Rule]:
    """Every path from the root to a node, from the printed form of a fitted forest (indented If and Else lines)."""
    rules, path = set(), []
    for line in text.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (-?[\d.eE+-]+)\)", line)
        if found:
            depth = len(found[1])
            path = [(d, cut) for d, cut in path if d < depth] + [(depth, (STATISTICS[int(found[2])], found[3], float(found[4])))]
            rules.add(Rule(cut for _, cut in path))
        elif re.match(r"\s*Tree \d+", line):
            path = []
    return rules


def held_out(id_column: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 by 3; a null id does not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, column: str, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most `limit` rows that are not held out and have id and label: those of least hash."""
    rows = labels.select(F.col("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> RuleModel:
    """Learn label 1 of `labels.quality`; without both labels in the sample every score is the share of 1 (or 0.5)."""
    sample = freeze(
        docs.select("doc_id", text_of("text").alias("text"))
        .join(F.broadcast(labelled_sample(labels, "quality", limit)), "doc_id")
        .select((F.col("label") == 1).cast("double").alias("label"), *statistics(F.col("text")))
    ).coalesce(4)  # of the rows written; the scan above keeps all its tasks
    n, positive = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or positive in (0, n):
        share = positive / n if n else 0.5
        return RuleModel(30.0 if share == 1 else -30.0 if share == 0 else 0.0, {})
    seen = VectorAssembler(inputCols=list(STATISTICS), outputCol="seen").transform(sample)
    forest = RandomForestClassifier(
        featuresCol="seen", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, featureSubsetStrategy="0.6"
    ).fit(seen)
    rules = sorted(tree_rules(forest.toDebugString), key=lambda r: sorted(r))
    if not rules:  # too few rows to cut
        return RuleModel(math.log(positive / (n - positive)), {})
    names = {s: s for s in STATISTICS}
    met = sample.select("label", *[holds(r, names).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    ruled = VectorAssembler(inputCols=met.columns[1:], outputCol="rules").transform(met).select("label", "rules").cache()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", regParam=LASSO, elasticNetParam=1.0, maxIter=60).fit(ruled)
    ruled.unpersist()
    return RuleModel(lasso.intercept, {r: float(w) for r, w in zip(rules, lasso.coefficients) if abs(w) > 1e-6})


def with_score(docs: DataFrame, model: RuleModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of its text; null counts as empty. A column named like `out` is replaced."""
    text, seen = fresh(docs, "_text", "_seen")
    # One struct out of a generator: a filter on the score cannot be moved below it, where each rule it names would
    # count its statistics anew.
    values = F.explode(F.array(F.struct(*statistics(F.col(text)))))
    wide = docs.withColumn(text, text_of(text_col)).select("*", values.alias(seen))
    return wide.withColumn(out, model.score({s: f"{seen}.{s}" for s in STATISTICS})).drop(text, seen)


def classify(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row given."""
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
